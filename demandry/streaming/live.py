"""A live daily view of arriving movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def daily_totals(stream: DataFrame, key: str, value: str, time: str = "ts", lateness: str = "2 days") -> DataFrame:
    """Count and sum per key and day.

    Days are fixed-length windows, so state is dropped once the watermark passes; a month key would keep
    it for good. Months are sums of closed days (:func:`monthly_from_daily`). Later rows are left to the ingest.
    """
    return (
        stream.withWatermark(time, lateness).groupBy(F.window(time, "1 day"), F.col(key))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").cast("date").alias("day"), key, "n", "total")
    )


def monthly_from_daily(daily: DataFrame, key: str) -> DataFrame:
    return daily.groupBy(key, F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def read_events(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def start_daily(daily: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a Parquet table, then stop when the input is used up."""
    return (
        daily.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
