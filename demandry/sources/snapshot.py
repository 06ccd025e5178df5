"""Stored results: whole results of a run per organization, and single results by key.

Data are written into folders of their own, and a manifest row, written last, makes them current. So a write is seen as a whole
or not at all, a retry writes a new folder, and readers open only folders that the manifest names. The manifest keeps each
table's schema, so a table without rows is read as it was written.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from demandry.session import grouped_for

_MANIFEST = "org_id string, load_id string, data_loaded boolean, updated_at timestamp, files_processed int, tables array<struct<name:string,schema:string>>"
_VERSIONS = "version string, created_at timestamp, keys array<string>, schema string, whole boolean"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest load of each organization; no rows before the first."""
    return latest_per_key(_rows(spark, f"{root}/manifest", _MANIFEST), ["org_id"], "updated_at")


def save_snapshot(
    tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], root: str, org_ids: DataFrame, files_processed: int, *, one: bool = False
) -> dict[str, DataFrame]:
    """Replace the results of the organizations in ``org_ids``, also by nothing; others stay as they were. Returns the tables as stored.

    An organization whose new result has no rows has none from then on. A table may be given as a function of those stored
    before it. Rows of ``one`` organization are written as they lie, others are gathered by organization before.
    """
    spark, root, load = org_ids.sparkSession, root.rstrip("/"), uuid.uuid4().hex
    orgs = org_ids.select("org_id").distinct()
    stored: dict[str, DataFrame] = {}
    for name, given in tables.items():
        df = given if isinstance(given, DataFrame) else given(stored)
        mine, path = df.join(orgs, "org_id", "left_semi"), f"{root}/{name}/load_id={load}"
        (mine if one else grouped_for(mine, "org_id")).write.partitionBy("org_id").parquet(path)
        stored[name] = spark.read.schema(df.schema).parquet(path).select(df.columns)
    schemas = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(df.schema.json()).alias("schema")) for name, df in stored.items()])
    orgs.select(
        "org_id", F.lit(load).alias("load_id"), F.lit(True).alias("data_loaded"), F.current_timestamp().alias("updated_at"),
        F.lit(files_processed).alias("files_processed"), schemas.alias("tables"),
    ).write.mode("append").parquet(f"{root}/manifest")
    return stored


def load_snapshot(spark: SparkSession, root: str, name: str, org_id: str | None = None) -> DataFrame:
    """The stored table ``name`` as of each organization's last load; ``org_id`` prunes to one.

    Only the folders of current loads are listed: at most one for each organization.
    """
    root = root.rstrip("/")
    schema_of = F.get(F.filter("tables", lambda t: t["name"] == name), F.lit(0))["schema"]
    current = _manifest(spark, root).where(schema_of.isNotNull())
    if org_id is not None:
        current = current.where(F.col("org_id") == org_id)
    loads = current.groupBy("load_id").agg(F.max("updated_at").alias("at"), F.first(schema_of).alias("schema")).orderBy("at").collect()
    if not loads:
        every = _rows(spark, f"{root}/manifest", _MANIFEST).where(schema_of.isNotNull())
        last = every.agg(F.max_by(schema_of, "updated_at").alias("schema")).first()["schema"]
        if last is None:
            raise ValueError(f"no stored table {name}")
        return spark.createDataFrame([], StructType.fromJson(json.loads(last)))
    schema = StructType.fromJson(json.loads(loads[-1]["schema"]))
    # As written, whatever the values in the folder names look like.
    stored = StructType([*schema.fields, StructField("load_id", StringType())])
    base = f"{root}/{name}"
    df = spark.read.schema(stored).option("basePath", base).parquet(*[f"{base}/load_id={r['load_id']}" for r in loads])
    if org_id is not None:
        df = df.where(F.col("org_id") == org_id)
    return df.join(current.select("org_id", "load_id"), ["org_id", "load_id"], "left_semi").select(*schema.names)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def expire(spark: SparkSession, root: str, before: dt.datetime) -> list[str]:
    """Remove the folders of loads that are no organization's last and were replaced ``before`` a time, at which no reader used them any more.

    Returns the loads removed. A load without any manifest row may still be being written, and stays.
    """
    root = root.rstrip("/")
    every = _rows(spark, f"{root}/manifest", _MANIFEST)
    current = _manifest(spark, root).select("load_id").distinct()
    old = every.groupBy("load_id").agg(F.max("updated_at").alias("at"), F.first("tables.name").alias("names"))
    gone = old.where(F.col("at") < F.lit(before)).join(current, "load_id", "left_anti").collect()  # one row for each load
    removed = []
    for r in gone:
        for name in r["names"] or []:
            if f"load_id={r['load_id']}" in _names(spark, f"{root}/{name}"):
                _delete(spark, f"{root}/{name}/load_id={r['load_id']}")
                removed.append(r["load_id"])
    return sorted(set(removed))


def save_results(df: DataFrame, root: str, name: str, keys: list[str]) -> str:
    """Add results, each of which replaces the one stored under its ``keys`` (such as project, product and model). Returns the version.

    Only the new rows are written. Of rows with equal keys in ``df`` itself, any one counts.
    """
    spark, base, version = df.sparkSession, f"{root.rstrip('/')}/{name}", uuid.uuid4().hex
    df.write.parquet(f"{base}/data/{version}")
    row = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("created_at"), F.array(*[F.lit(k) for k in keys]).alias("keys"),
        F.lit(df.schema.json()).alias("schema"), F.lit(False).alias("whole"),
    )
    row.write.mode("append").parquet(f"{base}/manifest")
    return version


def _versions(spark: SparkSession, base: str) -> list:
    """Versions in the order in which they were added, from the last whole one on: one row for each save since."""
    rows = sorted(_rows(spark, f"{base}/manifest", _VERSIONS).collect(), key=lambda r: (r["created_at"], r["whole"], r["version"]))
    return rows[max([i for i, r in enumerate(rows) if r["whole"]], default=0) :]


def load_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest result of each key, with created_at. Versions may differ in columns; a column that one lacks is null there."""
    base = f"{root.rstrip('/')}/{name}"
    versions = _versions(spark, base)
    if not versions:
        raise ValueError(f"no stored results {name}")
    out = None
    for r in versions:
        part = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{base}/data/{r['version']}")
        if "created_at" not in part.columns:
            part = part.withColumn("created_at", F.lit(r["created_at"]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return latest_per_key(out, list(versions[-1]["keys"]), "created_at")


def compact_results(spark: SparkSession, root: str, name: str) -> None:
    """Write the current results as one version, in place of all versions so far; readers of those must have ended."""
    base = f"{root.rstrip('/')}/{name}"
    versions = _versions(spark, base)
    whole = load_results(spark, root, name)
    version = uuid.uuid4().hex
    whole.write.parquet(f"{base}/data/{version}")
    last = versions[-1]
    row = [(version, last["created_at"], last["keys"], whole.schema.json(), True)]
    spark.createDataFrame(row, _VERSIONS).write.mode("append").parquet(f"{base}/manifest")
    for r in versions:
        _delete(spark, f"{base}/data/{r['version']}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All loads so far."""
    return spark.read.schema(_MANIFEST).parquet(f"{root.rstrip('/')}/manifest").drop("tables")


def freshness(manifest: DataFrame) -> DataFrame:
    """Latest load and files processed per organization."""
    return manifest.groupBy("org_id").agg(
        F.max("updated_at").alias("updated_at"), F.max_by("files_processed", "updated_at").alias("files_processed")
    )


def is_valid_result(df: DataFrame | None, required: list[str]) -> bool:
    """Whether a result has rows and the columns asked for."""
    return df is not None and set(required) <= set(df.columns) and not df.isEmpty()


def latest_per_key(results: DataFrame, keys: list[str], created: str) -> DataFrame:
    """The newest stored result of each key."""
    rest = [c for c in results.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(created, *[c for c in rest if c != created]))
    return results.groupBy(*keys).agg(newest.alias("__r")).select(*keys, "__r.*")
