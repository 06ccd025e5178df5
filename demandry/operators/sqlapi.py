"""SQL over registered tables, and the generic aggregations offered next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry.functions.ordered import in_order
from demandry.functions.quantile import stats_by_column

_OPS = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max, "min": F.min}


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """Ad-hoc SQL; values go in as named parameters (``:name``), not into the text."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def aggregate(df: DataFrame, group_by: list[str], columns: dict[str, str]) -> DataFrame:
    """``{column: operation}`` per group, named column_operation, ordered by the groups."""
    unknown = sorted(set(columns.values()) - set(_OPS))
    if unknown:
        raise ValueError(f"operations {unknown} are not among {sorted(_OPS)}")
    return df.groupBy(*group_by).agg(*[_OPS[op](c).alias(f"{c}_{op}") for c, op in columns.items()]).orderBy(*group_by)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of every numeric column, one row per column."""
    return stats_by_column(df, columns or numeric_columns(df), [0.25, 0.5, 0.75])


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Row number per key, for keys that hold any number of rows."""
    ranked = in_order(df, keys=keys, order=order, values={out: F.lit(1)})
    return ranked.withColumn(out, F.col(out).cast("bigint")).drop(f"{out}_total")


def preview(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(df: DataFrame) -> DataFrame:
    """(column, type, nullable, n_rows) of a table."""
    fields = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"))
            for f in df.schema
        ]
    )
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(fields), "n_rows")
