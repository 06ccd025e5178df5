"""Files of many tenants in one load, each read by the layout in its tenant's configuration row."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.sources import files
from demandry.sources import headers as H

# The defaults of a configuration row.
SEPARATOR, ENCODING = ",", "utf-8"
DEFAULT_MAPPING = {"product": "producto", "date": "fecha", "quantity": "cantidad", "company": "empresa"}


def layouts(config: DataFrame) -> DataFrame:
    """org_id, sep, encoding and mapping (header, name) of each configuration row.

    ``config`` has organization_id, csv_separator, csv_encoding and column_mapping, a JSON object from our names to
    headers. Missing values have the defaults; a mapping that is no such object, or an empty one, is null: no layout.
    """
    stated = F.coalesce(F.col("column_mapping"), F.lit(json.dumps(DEFAULT_MAPPING)))
    pairs = F.map_entries(F.from_json(stated, "map<string,string>"))
    named = F.filter(pairs, lambda p: F.coalesce(F.btrim(p["value"]), F.lit("")) != "")
    mapping = F.array_sort(F.transform(named, lambda p: F.struct(F.btrim(p["value"]).alias("header"), p["key"].alias("name"))))
    return config.select(
        F.col("organization_id").alias("org_id"),
        F.coalesce("csv_separator", F.lit(SEPARATOR)).alias("sep"),
        F.coalesce("csv_encoding", F.lit(ENCODING)).alias("encoding"),
        F.when(F.size(mapping) > 0, mapping).alias("mapping"),
    )


def organization(path: Column, root: str) -> Column:
    """The organization of a file laid out as root/organization/..., null for a file elsewhere."""
    plain = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, H.SCHEME, "")), "/+", "/")
    base = H.plain_path(root).rstrip("/") + "/"
    parts = F.split(F.substr(plain, F.lit(len(base) + 1)), "/")
    return F.when(F.startswith(plain, F.lit(base)) & (F.size(parts) > 1), parts[0])


def list_tenants(spark: SparkSession, root: str) -> DataFrame:
    """path and size_bytes of every file below the organizations' folders."""
    found = spark.read.schema(H.LISTED).format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("length").alias("size_bytes"))


@dataclass(frozen=True)
class TenantLoad:
    """Rows of the good files under our names, with org_id (none if no file is good), and all files with their verdicts."""

    rows: DataFrame | None
    files: DataFrame

    @property
    def refused(self) -> DataFrame:
        return self.files.where(~F.col("verdict").isin(H.GOOD, H.EMPTY))


def read_tenants(spark: SparkSession, root: str, config: DataFrame, required: list[str], listed: DataFrame | None = None) -> TenantLoad:
    """Read the files of all organizations below ``root``, or those ``listed``, each by its organization's layout.

    A file is good if its header has every column that the layout names and the layout names all that is ``required``.
    Files that are not hold none of the others back. Headers are read in one job; files of one layout and header are
    one scan, whichever organizations they belong to.
    """
    found = (list_tenants(spark, root) if listed is None else listed).withColumn("org_id", organization(F.col("path"), root))
    placed = found.join(layouts(config), "org_id", "left").withColumns(
        {"layout": F.to_json(F.struct("sep", "encoding", "mapping")), "encoding": F.coalesce("encoding", F.lit(ENCODING))}
    )
    table = H.with_headers(placed)
    # One row for each different layout and header.
    kinds = table.where(F.col("header").isNotNull()).groupBy("layout", "header", "encoding").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    good, lacks = [], []
    for r in sorted(kinds.collect()):
        stated = json.loads(r["layout"])
        mapping = {m["header"]: m["name"] for m in stated.get("mapping", [])}
        header = H.Header(0, r["header"], stated.get("sep", SEPARATOR), r["n"], r["path"])
        missing = header.missing(list(mapping)) + [c for c in required if c not in mapping.values()]
        lacks.append((r["layout"], r["header"], missing))
        if mapping and not missing:
            good.append((r["layout"], header, r["encoding"], mapping))
    verdicts = spark.createDataFrame(lacks, "layout string, header string, missing array<string>")
    judged = H.with_verdict(table.join(verdicts, ["layout", "header"], "left"))
    stateless = F.col("mapping").isNull() & F.col("header").isNotNull()
    judged = judged.withColumn("verdict", F.when(stateless, F.lit(H.NO_LAYOUT)).otherwise(F.col("verdict"))).drop("layout", "mapping")
    parts = []
    for layout, header, encoding, mapping in good:
        mine = table.where((F.col("layout") == layout) & (F.col("header") == header.line)).select("path")
        rows = files.read_columns(spark, sorted(r["path"] for r in mine.collect()), header, encoding)
        parts.append(rows.withColumnsRenamed(mapping))
    if not parts:
        return TenantLoad(None, judged)
    rows = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    # The source path is written as a URI.
    path = F.url_decode(F.replace(F.col("source_path"), F.lit("+"), F.lit("%2B")))
    return TenantLoad(rows.withColumn("org_id", organization(path, root)), judged)
