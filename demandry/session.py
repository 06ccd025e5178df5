"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)

# Written tables are compressed harder, and the shuffle files of a finished job go at once.
_SPARING = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# What we run with on a cluster; the caller's own settings win.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "demandry", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**RECOMMENDED, "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="demandry-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows (and any partition number stored with them) are fixed from here on, also when
    executors are lost, and the reread table has size statistics for join planning.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    owned(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def owned(path: str) -> None:
    """A folder of an intermediate table, which the innermost :func:`sparing` removes."""
    if (paths := _WRITTEN.get()) is not None:
        paths.append(path)


# One part for so many bytes of input, and no more than there are folders worth having.
_PART_BYTES, _PARTS = 16 << 20, 8


def parts_for(source: DataFrame) -> int:
    """In how many parts rows of a source are worked off, one after the other, so that little of the disk holds shuffled rows."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(_PARTS, size // _PART_BYTES))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours that is not read any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def sparing(spark: SparkSession) -> Iterator[list[str]]:
    """For work whose intermediate tables are larger than its input: inside, less of the disk is held.

    Tables are written with zstd, a job's shuffle files are removed as it ends, and the tables that :func:`materialize`
    writes (the paths given, of which the caller may take some out) are removed at the end: nothing lazy that reads them may leave.
    """
    before = {k: spark.conf.get(k) for k in _SPARING}
    token = _WRITTEN.set(paths := [])
    try:
        for k, v in _SPARING.items():
            spark.conf.set(k, v)
        yield paths
    finally:
        _WRITTEN.reset(token)
        for k, v in before.items():
            spark.conf.set(k, v)
        for path in paths:
            drop(spark, path)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows shuffled by columns into all shuffle partitions, for rows that grow many times afterwards: adaptive execution, which
    goes by their size now, would merge partitions that are large by then."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def grouped_for(df: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by partition column before a partitioned write: few files per folder, and a column
    value with very many rows is still split over several tasks.

    With adaptive execution the split follows the measured sizes; without it (inside streaming batches) every
    value is dealt over about the square root of the shuffle partitions.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.adaptive.enabled", "true") == "true":
        return df.hint("rebalance", *columns)
    deals = max(1, math.isqrt(int(conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(*columns, F.pmod(F.xxhash64(*df.columns), F.lit(deals)))
