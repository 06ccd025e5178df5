"""ABC classes, indicators of demand and stock, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import ratio
from demandry.functions.ordered import in_order


def abc(demand: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share, cumulated share and class of every product by total demand.

    The product that crosses a cut is classed by its own cumulated share. ``keys`` (``["org_id"]``) ranks inside
    each organization. Equal totals are ordered by product.
    """
    keys = keys or []
    totals = demand.groupBy(*keys, "product_id").agg(F.sum(F.coalesce("demand", F.lit(0.0))).alias("total"))
    ranked = in_order(totals, keys=keys, order=[F.desc("total"), F.asc("product_id")], values={"__cum": F.col("total")})
    grand = F.col("__cum_total")
    ranked = ranked.withColumns({"share": ratio(F.col("total"), grand), "cum_share": ratio(F.col("__cum"), grand)})
    a, b = S.ABC_CUTS
    cum = F.round("cum_share", 12)
    label = F.when(grand <= 0, "C").when(cum <= a, "A").when(cum <= b, "B").otherwise("C")
    return ranked.select(*keys, "product_id", "total", "share", "cum_share", label.alias("abc"))


def product_list(classes: DataFrame, abc_class: str | None = None) -> DataFrame:
    out = classes if abc_class is None else classes.where(F.col("abc") == abc_class)
    return out.select("product_id").distinct().orderBy("product_id")


def dataset_kpis(movements: DataFrame) -> DataFrame:
    """Size and coverage of a ledger in one row."""
    return movements.agg(
        F.count_distinct("product_id").alias("n_products"),
        F.count_distinct(F.when(F.col("kind") == S.SALE, F.col("month"))).alias("n_periods"),
        F.count_if(F.col("kind") == S.SALE).alias("n_sales"),
        F.count_if(F.col("kind") == S.PRODUCTION).alias("n_productions"),
        F.count("*").alias("n_movements"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count_distinct("channel").alias("n_channels"),
        F.count_distinct("client").alias("n_clients"),
        F.count_distinct("campaign").alias("n_campaigns"),
    )


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("abc").agg(F.count("*").alias("n_products"), F.sum("total").alias("total"))


def _last_two(value: str) -> list[Column]:
    """The last and the one before, from a history that has one row per month."""
    newest_first = F.sort_array(F.collect_list(F.struct("month", F.col(value).alias("v"))), asc=False)
    last = F.try_element_at(newest_first, F.lit(1))["v"]
    return [last.alias("last"), F.coalesce(F.try_element_at(newest_first, F.lit(2))["v"], last).alias("previous")]


def _pct(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b * 100).otherwise(F.lit(0.0))


def demand_kpis(demand: DataFrame) -> DataFrame:
    """Level, spread and recent trend per product; ``demand`` has one row per product and month."""
    base = demand.groupBy("product_id").agg(
        F.avg("demand").alias("mean"), F.max("demand").alias("max"), F.min("demand").alias("min"),
        F.stddev_samp("demand").alias("std"), *_last_two("demand"),
    )
    return base.withColumns(
        {
            "trend_pct": _pct(F.col("last"), F.col("previous")),
            "max_vs_mean_pct": _pct(F.col("max"), F.col("mean")),
            "min_vs_mean_pct": _pct(F.col("min"), F.col("mean")),
        }
    )


def component_shares(components: DataFrame) -> DataFrame:
    """Units and share of each demand component per product."""
    parts = ["store_sale", "consumption", "external"]
    sums = components.groupBy("product_id").agg(*[F.sum(c).alias(c) for c in parts])
    whole = F.col("store_sale") + F.col("consumption") + F.col("external")
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("units"), ratio(F.col(c), whole).alias("share")) for c in parts])
    return sums.select("product_id", F.inline(rows))


def stock_kpis(stock: DataFrame, demand: DataFrame, denominator: str = "days") -> DataFrame:
    """Level, occupancy and coverage per product.

    Daily demand is total demand over the calendar days of the table (``days``) or, as a known
    alternative, over the row count of the whole demand table (``table_rows``).
    """
    base = stock.groupBy("product_id").agg(
        F.avg("stock").alias("mean"), F.max("stock").alias("max"), F.min("stock").alias("min"), *_last_two("stock")
    )
    if denominator == "days":
        units = F.datediff(F.add_months(F.max("month"), 1), F.min("month"))
    elif denominator == "table_rows":
        units = F.count("*")
    else:
        raise ValueError(f"unknown denominator {denominator}")
    per = demand.agg(units.cast("double").alias("u")).scalar()
    daily = demand.groupBy("product_id").agg(F.sum("demand").alias("__d")).select("product_id", (F.col("__d") / per).alias("daily_demand"))
    occupancy = F.when(F.col("max") != 0, F.col("last") / F.col("max") * 100).otherwise(F.lit(0.0))
    out = base.join(daily, "product_id", "left").withColumns(
        {
            "daily_demand": F.coalesce("daily_demand", F.lit(1.0)),
            "change": F.col("last") - F.col("previous"),
            "occupancy_pct": occupancy,
        }
    )
    out = out.withColumn("coverage_days", ratio(F.col("last"), F.col("daily_demand")))
    occ, cov = F.col("occupancy_pct"), F.col("coverage_days")
    return out.withColumns(
        {
            "occupancy_status": F.when(occ.between(30, 80), "optimal").when(occ > 80, "review").otherwise("low"),
            "coverage_status": F.when(cov >= 7, "good").when(cov >= 3, "tight").otherwise("critical"),
        }
    )


def stock_volatility(stock: DataFrame) -> DataFrame:
    """Spread of month-end stock per product and how often it is below its mean."""
    w = Window.partitionBy("product_id")
    out = (
        stock.withColumn("__mean", F.avg("stock").over(w)).groupBy("product_id")
        .agg(
            F.avg("stock").alias("mean"),
            F.stddev_samp("stock").alias("std"),
            F.count_if(F.col("stock") < F.col("__mean")).alias("months_below_mean"),
            F.count("*").alias("n_months"),
            (F.max("stock") - F.min("stock")).alias("range"),
        )
    )
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean") * 100).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "cv_pct": cv,
            "below_pct": 100.0 * F.col("months_below_mean") / F.col("n_months"),
            "status": F.when(cv > 50, "high").when(cv > 25, "moderate").otherwise("stable"),
        }
    )


def top_products(demand: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` products with most demand, with active months and mean per month."""
    return (
        demand.groupBy("product_id").agg(F.sum("demand").alias("total"), F.count("*").alias("n_months"))
        .withColumn("per_month", F.col("total") / F.col("n_months"))
        .orderBy(F.desc("total"), "product_id").limit(n)
    )


def product_catalogue(movements: DataFrame) -> DataFrame:
    return movements.select("product_id", "product_name").distinct()


def sales_by(movements: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Rows, units, mean units and value of one kind of movement per key."""
    return (
        movements.where(F.col("kind") == kind).groupBy(*keys)
        .agg(F.count("*").alias("n"), F.sum("qty").alias("units"), F.avg("qty").alias("mean_units"), F.sum("total_value").alias("value"))
    )


def mean_stock(movements: DataFrame) -> DataFrame:
    return movements.groupBy("product_id").agg(F.avg("stock_after").alias("mean_stock"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, long form, one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))
