"""Reports on what a ledger holds and where it breaks its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry import schema as S
from demandry.functions.quantile import exact_percentiles, long_values, stats_by_column
from demandry.operators.sqlapi import numeric_columns


def anomaly_profile(df: DataFrame, columns: list[str], fence: float = 1.5) -> DataFrame:
    """Mean, median, std, min, max per column and the values outside the quartile fences."""
    stats = stats_by_column(df, columns, [0.25, 0.5, 0.75])
    iqr = F.col("p75") - F.col("p25")
    # One row per column.
    limits = stats.select("column", (F.col("p25") - fence * iqr).alias("low"), (F.col("p75") + fence * iqr).alias("high"))
    outside = (
        long_values(df, columns).join(F.broadcast(limits), "column").groupBy("column", "low", "high")
        .agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("n_outliers"))
    )
    total = df.agg(F.count("*").alias("n")).scalar()
    return stats.join(outside, "column").select(
        "column", "mean", F.col("p50").alias("median"), "std", "min", "max", "low", "high", "n_outliers",
        (100.0 * F.col("n_outliers") / total).alias("outlier_pct"),
    )


def absurd_values(df: DataFrame, columns: list[str], limit: float = S.ABSURD_VALUE) -> DataFrame:
    """Values above ``limit`` per column."""
    counts = df.agg(*[F.count_if(F.col(c) > limit).alias(c) for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_absurd"), F.col(f"max_{c}").alias("max")) for c in columns])
    return counts.select(F.inline(rows))


def negative_stock(df: DataFrame) -> DataFrame:
    """How many balances are negative, how far, for how many products, and a verdict; one row."""
    s = F.col("stock_after")
    neg = F.when(s < 0, s)
    base = df.agg(
        F.count("*").alias("n_rows"),
        F.min(s).alias("min_stock"),
        F.max(s).alias("max_stock"),
        F.avg(s).alias("mean_stock"),
        F.count(neg).alias("n_negative"),
        F.min(neg).alias("min_negative"),
        F.max(neg).alias("max_negative"),
        F.avg(neg).alias("mean_negative"),
        F.count_if(s < -100).alias("n_below_100"),
        F.count_if((s >= -100) & (s < -10)).alias("n_100_to_10"),
        F.count_if((s >= -10) & (s < 0)).alias("n_above_10"),
        F.count_distinct(F.when(s < 0, F.col("product_id"))).alias("n_products_negative"),
    )
    median = exact_percentiles(df.where(s < 0), ["stock_after"], [0.5]).select(F.col("value")).scalar()
    share = F.when(F.col("n_rows") > 0, F.col("n_negative") / F.col("n_rows")).otherwise(F.lit(0.0))
    return base.withColumns(
        {
            "median_negative": median,
            "negative_pct": 100 * share,
            "verdict": F.when(share > 0.10, "high").when(share > 0.02, "moderate").otherwise("low"),
        }
    )


def worst_balances(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("stock_after", "product_id", "date", "row_seq").limit(n).select("product_id", "date", "stock_after")


def negative_by_warehouse(df: DataFrame) -> DataFrame:
    return df.groupBy("warehouse").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("stock_after") < 0).alias("n_negative"),
        (100.0 * F.count_if(F.col("stock_after") < 0) / F.count("*")).alias("negative_pct"),
    )


def cost_constancy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct production costs per key (product, product and day, product and month, product and client)."""
    return (
        df.where((F.col("kind") == S.PRODUCTION)).groupBy(*keys)
        .agg(
            F.count("*").alias("n_rows"), F.count_distinct("unit_cost").alias("n_costs"),
            F.min("unit_cost").alias("min_cost"), F.max("unit_cost").alias("max_cost"),
        )
        .withColumn("constant", F.col("n_costs") <= 1)
    )


def varying_costs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only the keys with more than one cost."""
    return cost_constancy(df, keys).where(~F.col("constant"))


def first_costs(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` smallest distinct costs of each product."""
    w = Window.partitionBy("product_id").orderBy("unit_cost")
    return (
        df.where((F.col("kind") == S.PRODUCTION) & F.col("unit_cost").isNotNull()).groupBy("product_id", "unit_cost").agg(F.count("*").alias("n_rows"))
        .withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    )


def cost_stats(df: DataFrame, digits: int = 3) -> DataFrame:
    """Spread of production cost per product, rounded."""
    m, s = F.avg("unit_cost"), F.stddev_samp("unit_cost")
    return df.where(F.col("kind") == S.PRODUCTION).groupBy("product_id").agg(
        F.round(F.min("unit_cost"), digits).alias("min"), F.round(F.max("unit_cost"), digits).alias("max"), F.round(m, digits).alias("mean"),
        F.round(s, digits).alias("std"), F.round(s / m * 100, digits).alias("cv_pct"),
    )


def rows_per_day(df: DataFrame) -> DataFrame:
    """Mean, least and most movements on a day that has any."""
    return df.groupBy("date").agg(F.count("*").alias("n")).agg(
        F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.count("*").alias("n_days")
    )


def rows_per_month(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.count("*").alias("n"))


def channel_pos_check(df: DataFrame, physical: list[str]) -> DataFrame:
    """Points of sale where there should be one and where there should be none; one row."""
    sale = F.col("kind") == S.SALE
    shop = F.coalesce(F.col("channel").isin(*physical), F.lit(False))
    has = F.col("pos").isNotNull()
    n_shop = F.count_if(sale & shop)
    return df.agg(
        F.count_if(sale & shop & has).alias("physical_with_pos"),
        F.count_if(sale & shop & ~has).alias("physical_without_pos"),
        F.count_if(sale & ~shop).alias("online"),
        F.count_if(sale & ~shop & has).alias("online_with_pos"),
        F.count_if((F.col("kind") == S.PRODUCTION) & has).alias("production_with_pos"),
        F.when(n_shop > 0, 100.0 * F.count_if(sale & shop & has) / n_shop).alias("with_pos_pct"),
    )


def pos_shares(df: DataFrame, physical: list[str]) -> DataFrame:
    """Sales per point of sale as a share of all physical sales."""
    shop = df.where((F.col("kind") == S.SALE) & F.col("channel").isin(*physical))
    total = shop.agg(F.count("*").alias("n")).scalar()
    return shop.where(F.col("pos").isNotNull()).groupBy("pos").agg(F.count("*").alias("n")).withColumn("pct", 100.0 * F.col("n") / total)


def kind_mix(df: DataFrame) -> DataFrame:
    """Rows, share, sign mix and range of quantities per kind."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy("kind").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("qty") > 0).alias("n_positive"),
        F.count_if(F.col("qty") < 0).alias("n_negative"),
        F.count_if(F.col("qty") == 0).alias("n_zero"),
        F.min("qty").alias("min_qty"), F.max("qty").alias("max_qty"), F.avg("qty").alias("mean_qty"), F.stddev_samp("qty").alias("std_qty"),
    ).withColumn("pct", 100.0 * F.col("n_rows") / total)


def column_profile(df: DataFrame) -> DataFrame:
    """Type, whether numeric, and filled and missing rows of every column."""
    numeric = set(numeric_columns(df))
    wide = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"), F.lit("numeric" if f.name in numeric else "text" if isinstance(f.dataType, T.StringType) else "other").alias("family"),
                F.col(f.name).alias("n_filled"), (F.col("__n") - F.col(f.name)).alias("n_missing"),
            )
            for f in df.schema
        ]
    )
    return wide.select(F.inline(rows))


def null_rules(df: DataFrame) -> DataFrame:
    """Rows that break the null pattern of their kind, per rule."""
    sale, prod = F.col("kind") == S.SALE, F.col("kind") == S.PRODUCTION
    rules: dict[str, Column] = {
        "sale_has_no_cost": sale & F.col("unit_cost").isNotNull(),
        "sale_has_price": sale & F.col("unit_price").isNull(),
        "sale_has_client": sale & F.col("client").isNull(),
        "production_has_cost": prod & F.col("unit_cost").isNull(),
        "production_has_no_client": prod & F.col("client").isNotNull(),
        "production_has_no_price": prod & F.col("unit_price").isNotNull(),
        "production_has_no_pos": prod & F.col("pos").isNotNull(),
    }
    wide = df.agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_broken")) for r in rules])))


def year_flow(df: DataFrame) -> DataFrame:
    """Balances and flows per year: negative share, range, units in and out, out/in."""
    return df.groupBy("year").agg(
        F.count("*").alias("n_rows"),
        (100.0 * F.count_if(F.col("stock_after") < 0) / F.count("*")).alias("negative_pct"),
        F.min("stock_after").alias("min_stock"), F.max("stock_after").alias("max_stock"),
        F.sum("in_units").alias("units_in"), F.sum("out_units").alias("units_out"),
    ).withColumn("out_in_ratio", F.coalesce(F.when(F.col("units_in") > 0, F.try_divide("units_out", "units_in")), F.lit(0.0)))


def rows_per_year(df: DataFrame) -> DataFrame:
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.groupBy("year").agg(F.count("*").alias("n_rows")).withColumn("pct", 100.0 * F.col("n_rows") / total)


def whole_against_parts(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """Whether the parts together hold the rows of the whole: counts, rows on one side only, same columns.

    One shuffle: rows are counted +1/-1 and cancelled by value.
    """
    same = sorted(whole.columns) == sorted(parts.columns)
    cols = [c for c in whole.columns if c in parts.columns]
    types = {f.name: f.dataType for f in whole.schema}
    same_types = all(types[f.name] == f.dataType for f in parts.schema if f.name in types)
    both = whole.select(*cols, F.lit(1).alias("__w")).unionByName(parts.select(*cols, F.lit(-1).alias("__w")))
    per_row = both.groupBy(*cols).agg(
        F.count_if(F.col("__w") > 0).alias("a"), F.count_if(F.col("__w") < 0).alias("b"), F.sum("__w").alias("d")
    )
    return per_row.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_whole"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_parts"),
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("n_extra"),
        F.lit(same).alias("same_columns"),
        F.lit(same_types).alias("same_types"),
    )


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows after each stage of a run."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("position"), F.lit(name).alias("stage"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
