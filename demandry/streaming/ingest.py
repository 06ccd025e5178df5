"""Incremental ingest of ledger files: only the months a batch touches are rebuilt.

With a configuration of organizations, files lie below a folder for each organization and are read by its layout; all state is
then kept by organization and month, and products of one code in two organizations never mix. A file without the required
columns goes to the quarantine table and holds nothing else back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from demandry import schema as S
from demandry.operators import build as B
from demandry.operators import clean as C
from demandry.session import drop, fresh_path, grouped_for, parts_for
from demandry.sources import files, layouts
from demandry.sources import headers as H

# Within a day, rows stand as their batches came and as their files hold them.
_ORDER = ["batch_id", "source_no", "source_path", "source_file", "row_block", "row_seq"]


@dataclass(frozen=True)
class Store:
    """Folder layout of the ledger and its monthly tables, all partitioned by month (and organization)."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _overwrite(df: DataFrame, path: str, by: list[str], counted: Observation | None = None) -> None:
    """Replace the partitions that ``df`` has rows for; its rows are counted as they are written."""
    rows = grouped_for(df, *by)
    rows = rows if counted is None else rows.observe(counted, F.count("*").alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _partitions(spark: SparkSession, path: str, schema: StructType, keys: list[str], values: list[tuple]) -> DataFrame:
    """The rows of some partitions; only their folders are listed, and one without rows has none."""
    folders = ["/".join([path, *[f"{k}={v}" for k, v in zip(keys, some)]]) for some in values]
    folders = [f for f in folders if H.exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def apply_batch(raw: DataFrame, batch_id: int, store: Store, scope: Sequence[str] = ()) -> None:
    """Add one batch of raw rows and rebuild demand and stock of its months, by the columns of ``scope`` if there are any.

    Every write replaces whole partitions (the batch's own slice of the ledger, the touched months of
    the tables, the batch's audit row), so running the same batch again changes nothing. A batch without any valid
    row, or without sales, is a batch like any other. Files are parsed once, and every count is taken as its rows are read or written.
    """
    spark, scope = raw.sparkSession, list(scope)
    if "row_seq" not in raw.columns:
        # Rows of one file split stay in one task and in order, so this numbers them within the split.
        raw = raw.withColumn("row_seq", F.monotonically_increasing_id())
    read = Observation()
    cleaned = C.clean(raw, read=read).withColumns({"month": F.trunc("date", "month"), "batch_id": F.lit(batch_id)})
    by, keys = [*scope, "month"], [*scope, "product_id"]
    # Months are worked off in parts: only those of one are shuffled at a time, and what was parsed of them goes.
    n = parts_for(raw)
    part = F.pmod(F.year("month") * 12 + F.month("month"), F.lit(n))
    stored = StructType([*cleaned.schema.fields, StructField("part", IntegerType())])
    path = fresh_path(spark, "batch")
    cleaned.withColumn("part", part).write.partitionBy("part").parquet(path)
    batch = spark.read.schema(stored).parquet(path)
    kept = batch.groupBy("part", *by).agg(F.count("*").alias("n")).collect()  # one row for each month that it touches
    touched = {k: sorted(tuple(r[c] for c in by) for r in kept if r["part"] == k) for k in sorted({r["part"] for r in kept})}
    counts = {"n_raw": read.get["n"], "n_clean": sum(r["n"] for r in kept), "n_demand": 0, "n_stock": 0}
    for k, some in touched.items():
        mine = spark.read.schema(stored).parquet(path).where(F.col("part") == k).drop("part")
        _overwrite(mine, store.path("ledger"), [*by, "batch_id"])
        drop(spark, f"{path}/part={k}")
        ledger = _partitions(spark, store.path("ledger"), cleaned.schema, by, some)
        ledger, order = files.ranked_sources(ledger, ["date", *[c for c in _ORDER if c in ledger.columns]])
        for name, table in (("n_demand", B.demand_monthly(ledger, keys)), ("n_stock", B.stock_monthly(ledger, keys, order))):
            _overwrite(table, store.path(name.replace("n_", "") + "_monthly"), by, seen := Observation())
            counts[name] += seen.get["n"]
    drop(spark, path)
    audit = spark.range(1).select(
        F.lit(batch_id).alias("batch_id"),
        *[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()],
        F.current_timestamp().alias("processed_at"),
    )
    _overwrite(audit, store.path("audit"), ["batch_id"])


def _quarantine(judged: DataFrame, batch_id: int, store: Store) -> None:
    """Refused files of a batch, with what each lacks. The rows of a batch are replaced, so a rerun changes nothing."""
    refused = judged.where(~F.col("verdict").isin(H.GOOD, H.EMPTY))
    org = F.col("org_id") if "org_id" in judged.columns else F.lit(None).cast("string")
    rows = refused.select(org.alias("org_id"), "path", "size_bytes", "header", "missing", "verdict", F.lit(batch_id).alias("batch_id"))
    _overwrite(rows, store.path("quarantine"), ["batch_id"])


QUARANTINE = "org_id string, path string, size_bytes bigint, header string, missing array<string>, verdict string, batch_id int"


def quarantine(spark: SparkSession, store: Store) -> DataFrame:
    """All refused files so far."""
    if not H.exists(spark, store.path("quarantine")):
        return spark.createDataFrame([], QUARANTINE)
    return spark.read.schema(QUARANTINE).parquet(store.path("quarantine"))


def ingest(
    spark: SparkSession, inbox: str, store: Store, layout: files.CsvLayout = files.CsvLayout(), *, config: DataFrame | None = None  # noqa: B008
) -> StreamingQuery:
    """Process every file not seen before, then stop. Files already recorded in the checkpoint are skipped.

    The stream says which files are new; their rows are read by header name, as everywhere, so files of one batch may
    order their columns differently. Without ``config`` all files lie in the inbox and have one layout. With it they lie
    below inbox/organization and have the layouts of its rows (see :func:`layouts.layouts`), whose names are the ledger's headers.
    """
    reader = spark.readStream.schema(H.LISTED).format("binaryFile")
    reader = reader if config is None else reader.option("recursiveFileLookup", True)
    new = reader.load(inbox).select("path", F.col("length").alias("size_bytes"))

    def one_layout(found: DataFrame, batch_id: int) -> None:
        table = H.with_headers(found.select(F.lit(0).alias("source_no"), "path", "size_bytes", F.lit(layout.encoding).alias("encoding")))
        required = [*layout.mapping, *[c for c in S.REQUIRED if c not in layout.mapping.values()]]
        heads = H.headers(table, layout.sep)
        _quarantine(H.judged(table, heads, required), batch_id, store)
        good = [h for h in heads if not h.missing(required)]
        if good:
            rows = files.read_found(table, good, None, layout.encoding).withColumnsRenamed(layout.mapping)
            apply_batch(rows, batch_id, store)

    def by_organization(found: DataFrame, batch_id: int) -> None:
        load = layouts.read_tenants(spark, inbox, config, S.REQUIRED, found)
        _quarantine(load.files, batch_id, store)
        if load.rows is not None:
            apply_batch(load.rows, batch_id, store, ["org_id"])

    batch = one_layout if config is None else by_organization
    return new.writeStream.foreachBatch(batch).option("checkpointLocation", store.path("_checkpoint")).trigger(availableNow=True).start()
