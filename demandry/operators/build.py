"""Monthly demand and stock, reconciliation of guides, series completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import month_of, strip
from demandry.functions.ordered import running_balance, with_group_totals
from demandry.session import dealt


def _with_month(df: DataFrame) -> DataFrame:
    return df if "month" in df.columns else df.withColumn("month", month_of("date"))


def demand_monthly(movements: DataFrame, keys: list[str] = ["product_id"]) -> DataFrame:  # noqa: B006
    """Units sold per product and month: |sum|, not the sum of absolutes."""
    return (
        _with_month(movements).where(F.col("kind") == S.SALE)
        .groupBy(*keys, "month").agg(F.abs(F.sum("qty")).alias("demand"))
    )


def demand_with_value(movements: DataFrame) -> DataFrame:
    return (
        _with_month(movements).where(F.col("kind") == S.SALE).groupBy("product_id", "month")
        .agg(F.sum("qty").alias("demand"), F.sum("total_value").alias("total_value"), F.avg("discount_pct").alias("mean_discount"))
    )


def demand_by_client(movements: DataFrame) -> DataFrame:
    return (
        _with_month(movements).where(F.col("kind") == S.SALE).groupBy("product_id", "client", "month")
        .agg(F.sum("qty").alias("demand"), F.sum("total_value").alias("total_value"))
    )


def stock_monthly(movements: DataFrame, keys: list[str] = ["product_id"], order: list[str] = ["date", "row_block", "row_seq"]) -> DataFrame:  # noqa: B006
    """Balance after the last movement of each month; a missing balance counts as 0.

    Add ``warehouse`` (or any other holder of a balance) to ``keys`` for stock by holder. An aggregate,
    not a window: each task keeps one row per key and month.
    """
    last = F.max_by(F.coalesce(F.col("stock_after"), F.lit(0.0)), F.struct(*order))
    return _with_month(movements).groupBy(*keys, "month").agg(last.alias("stock"))


def stock_with_average(movements: DataFrame, order: list[str] = ["date", "row_block", "row_seq"]) -> DataFrame:  # noqa: B006
    return _with_month(movements).groupBy("product_id", "month").agg(
        F.max_by("stock_after", F.struct(*order)).alias("stock"), F.avg("stock_after").alias("mean_stock")
    )


def reconcile_guides(movements: DataFrame, guide_docs: list[str] = [S.DOC_GUIDE], prorate: bool = True, spread: Column | None = None) -> DataFrame:  # noqa: B006
    """Label guide rows as internal transfers or external sales and give each its external units.

    A (document, number, product, month) group without units out, or with any units in, is a
    transfer. Otherwise its units out were sold; each row gets its own share (``prorate``) or, as a known
    alternative, the group's whole sum.
    """
    keys = ["doc", "doc_no", "product_id", "month"]
    rows = _with_month(movements).withColumns(
        {"in_units": F.coalesce("in_units", F.lit(0.0)), "out_units": F.coalesce("out_units", F.lit(0.0))}
    )
    is_guide = F.coalesce(F.col("doc").isin(*guide_docs), F.lit(False))
    guides = rows.where(is_guide)
    totals = guides.groupBy(*keys).agg(
        F.sum("out_units").alias("__out"), F.sum("in_units").alias("__in"), F.count("*").alias("__n")
    )
    spread = spread if spread is not None else (F.col("row_seq") if "row_seq" in rows.columns else F.monotonically_increasing_id())
    external = (F.col("__out") > 0) & (F.col("__in") <= 0)
    share = F.when((F.col("out_units") > 0), F.col("out_units")).otherwise(F.lit(0.0)) if prorate else F.col("__out")
    labelled = with_group_totals(guides, totals, keys, "__n", spread).withColumns(
        {
            "guide_type": F.when(external, S.GUIDE_EXTERNAL).otherwise(S.GUIDE_TRANSFER),
            "external_units": F.when(external, share).otherwise(F.lit(0.0)),
        }
    ).drop("__out", "__in")
    others = rows.where(~is_guide).withColumns({"guide_type": F.lit(S.GUIDE_NONE), "external_units": F.lit(0.0)})
    return others.unionByName(labelled)


def complete_series(
    demand: DataFrame, key: str = "product_id", value: str = "demand", start: str | None = None, end: str | None = None, scope: Column | None = None
) -> DataFrame:
    """Every product in every month between the first and last month of the table (or ``start``/``end``); gaps are 0.

    With a ``scope`` (the organization of a product) the months are those of its own scope.

    Each row is stretched up to the product's next month, so there is neither a products x months
    product nor a join, and the result stays partitioned by product for the windows that follow. As a few rows become as many
    as there are months, they are dealt over all shuffle partitions before.
    """
    bounds = demand.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    first = F.lit(start).cast("date") if start else bounds.select("a").scalar()
    last = F.lit(end).cast("date") if end else bounds.select("b").scalar()
    per_product = Window.partitionBy(key).orderBy("month")
    held = []
    if scope is not None:
        # One row per scope, joined to monthly rows; adaptive execution sends it to them.
        own = demand.groupBy(scope.alias("__scope")).agg(F.min("month").alias("__first"), F.max("month").alias("__last"))
        demand, held = demand.withColumn("__scope", scope).join(own, "__scope"), ["__first", "__last"]
        first, last = (F.lit(start).cast("date") if start else F.col("__first")), (F.lit(end).cast("date") if end else F.col("__last"))
    rows = demand.select(strip(key).alias(key), "month", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value), *held)
    if start or end:
        # A product without months inside the bounds still gets its row of zeros.
        inside = F.when(F.col("month").between(first, last), F.col("month"))
        rows = rows.groupBy(key, *held, inside.alias("month")).agg(F.sum(F.when(inside.isNotNull(), F.col(value)).otherwise(0.0)).alias(value))
    rows = dealt(rows, key)
    if start or end:
        whole = Window.partitionBy(key)
        rows = rows.withColumn("__any", F.count("month").over(whole)).where(F.col("month").isNotNull() | (F.col("__any") == 0)).drop("__any")
    begin = F.when(F.lag("month").over(per_product).isNull() & (F.row_number().over(per_product) == 1), first).otherwise(F.col("month"))
    stop = F.coalesce(F.add_months(F.lead("month").over(per_product), -1), last)
    return (
        rows.withColumns({"__begin": begin, "__stop": stop})
        .withColumn("__month", F.explode(F.sequence("__begin", "__stop", F.expr("interval 1 month"))))
        .select(key, F.col("__month").alias("month"), F.when(F.col("__month") == F.col("month"), F.col(value)).otherwise(F.lit(0.0)).alias(value))
    )


def demand_components(movements: DataFrame, sale_docs: list[str], consumption_docs: list[str]) -> DataFrame:
    """Store sales, consumption and external guide units per product and month, with gaps filled per product.

    ``movements`` are reconciled rows. All products in one aggregation.
    """
    doc = strip("doc")
    monthly = _with_month(movements).groupBy("product_id", "month").agg(
        F.sum(F.when(doc.isin(*sale_docs), F.col("out_units")).otherwise(F.lit(0.0))).alias("store_sale"),
        F.sum(F.when(doc.isin(*consumption_docs), F.col("out_units")).otherwise(F.lit(0.0))).alias("consumption"),
        F.sum(F.when(F.col("guide_type") == S.GUIDE_EXTERNAL, F.col("external_units")).otherwise(F.lit(0.0))).alias("external"),
    )
    w = Window.partitionBy("product_id").orderBy("month")
    stop = F.coalesce(F.add_months(F.lead("month").over(w), -1), F.col("month"))
    at = lambda c: F.when(F.col("__m") == F.col("month"), F.col(c)).otherwise(F.lit(0.0))
    filled = (
        monthly.withColumn("__stop", stop)
        .withColumn("__m", F.explode(F.sequence("month", "__stop", F.expr("interval 1 month"))))
        .select("product_id", F.col("__m").alias("month"), *[at(c).alias(c) for c in ("store_sale", "consumption", "external")])
    )
    return filled.withColumn("demand", F.col("store_sale") + F.col("consumption") + F.col("external"))


def product_demand(demand: DataFrame, products: DataFrame, name_part: str | None = None) -> DataFrame:
    """Demand of the products whose name contains the text (any case), or all demand."""
    if name_part is None:
        return demand
    hits = products.where(F.lower("product_name").contains(name_part.lower())).select("product_id").distinct()
    return demand.join(hits, "product_id", "left_semi")


def union_ledgers(parts: list[DataFrame]) -> DataFrame:
    """Yearly ledgers as one; columns missing from a year are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def demand_groupings(movements: DataFrame) -> DataFrame:
    """count, sum, mean, std, min and max of sold units by channel, by campaign and by product, in one pass."""
    sold = movements.where(F.col("kind") == S.SALE).select("channel", "campaign", "product_id", "qty")
    sets = [["channel"], ["campaign"], ["product_id"]]
    level = F.when(F.grouping("channel") == 0, "channel").when(F.grouping("campaign") == 0, "campaign").otherwise("product")
    return (
        sold.groupingSets(sets, "channel", "campaign", "product_id")
        .agg(
            level.alias("level"),
            F.count("qty").alias("n"),
            F.sum("qty").alias("total"),
            F.avg("qty").alias("mean"),
            F.stddev_samp("qty").alias("std"),
            F.min("qty").alias("min"),
            F.max("qty").alias("max"),
        )
        .select("level", F.coalesce("channel", "campaign", "product_id").alias("value"), "n", "total", "mean", "std", "min", "max")
    )


def warehouse_balance(movements: DataFrame, opening: float = 0.0) -> DataFrame:
    """Running balance per product and warehouse: opening plus everything in minus everything out."""
    rows = _with_month(movements)
    # Within a day by file, in the order in which the files were given, and within a file by its blocks.
    blocks = [c for c in ("source_no", "source_path", "row_block") if c in rows.columns]
    out = running_balance(
        rows, F.col("in_units") - F.col("out_units"), keys=["product_id", "warehouse"], coarse="month",
        fine=["date", *blocks], order=["row_seq"], out="balance",
    )
    return out.withColumn("balance", F.col("balance") + opening)
