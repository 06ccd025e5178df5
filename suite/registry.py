"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a query. ``digits`` rounds the named columns alike on both sides."""
    digits = digits or {}

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()}) if digits else out

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in digits.items())
            ORACLE[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS q" if digits else sql
        return fn

    return add


def each(columns: str, n: int) -> dict[str, int]:
    return {c: n for c in columns.split()}
