"""Safety stock, production quantities and the replay of inventory policies over history.

The replays are recursions in the stock, S' = f(S), but both have closed forms in running sums and extrema,
so they run as windows over all products instead of a loop per product:

* order what was sold last month, S' = max(0, S + q - d):  S = Y + max(S0, -min Y), Y = running sum of q - d
* order up to T, S' = max(0, max(S, T) - d):  S = -D + max(S0, max(max(T - d, 0) + D)), D = running sum of d
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.functions.columns import newsvendor_z, service_level, z_of_service_level
from demandry.operators import history as HI


def safety_stock(z: float | Column, sigma: Column, lead_time: int = 1) -> Column:
    zc = F.lit(z) if isinstance(z, (int, float)) else z
    return F.greatest(F.lit(0.0), zc * sigma * math.sqrt(float(lead_time)))


def production_quantity(forecast: Column, ss: Column, stock: Column) -> Column:
    return F.greatest(F.lit(0.0), forecast + ss - stock)


def policy_levels(classes: DataFrame) -> DataFrame:
    """Service level and Z of every product's class."""
    out = classes.withColumn("service_level", service_level("abc"))
    return out.withColumn("z_policy", z_of_service_level("service_level"))


def _snap(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-9, F.lit(0.0)).otherwise(x)


def _by_product() -> Window:
    return Window.partitionBy("product_id").orderBy("month")


def _running() -> Window:
    return _by_product().rowsBetween(Window.unboundedPreceding, 0)


def _order_up_to(rows: DataFrame, target: str, prefix: str) -> DataFrame:
    """Stock, order, served and lost units when ordering up to ``target``; needs demand and s0."""
    p = lambda n: f"{prefix}{n}"
    rows = rows.withColumn("__D", F.sum("demand").over(_running()))
    peak = F.max(F.greatest(F.col(target) - F.col("demand"), F.lit(0.0)) + F.col("__D")).over(_running())
    rows = rows.withColumn(p("stock_end"), F.greatest(F.lit(0.0), _snap(F.greatest(F.col("s0"), peak) - F.col("__D"))))
    return _month_flows(rows.drop("__D"), F.greatest(F.lit(0.0), F.col(target) - F.col(p("stock_start"))), prefix)


def _repeat_last(rows: DataFrame, prefix: str) -> DataFrame:
    """The same when ordering last month's demand; needs demand, prev_demand and s0."""
    q = F.greatest(F.lit(0.0), F.col("prev_demand"))
    rows = rows.withColumn("__Y", F.sum(q - F.col("demand")).over(_running()))
    low = F.min("__Y").over(_running())
    rows = rows.withColumn(f"{prefix}stock_end", F.greatest(F.lit(0.0), _snap(F.col("__Y") + F.greatest(F.col("s0"), -low))))
    return _month_flows(rows.drop("__Y"), q, prefix)


def _month_flows(rows: DataFrame, order: Column, prefix: str) -> DataFrame:
    p = lambda n: f"{prefix}{n}"
    rows = rows.withColumn(p("stock_start"), F.coalesce(F.lag(p("stock_end")).over(_by_product()), F.col("s0")))
    rows = rows.withColumn(p("order"), order)
    available = F.col(p("stock_start")) + F.col(p("order"))
    return rows.withColumns(
        {
            p("lost"): F.greatest(F.lit(0.0), _snap(F.col("demand") - available)),
            p("served"): F.least(available, F.col("demand")),
        }
    )


def _eval_months(n: Column, months: int) -> Column:
    """Months replayed: fewer when the history is short."""
    return F.when(n < months + 6, F.least(F.lit(months), F.greatest(F.lit(1), n - 2))).otherwise(F.lit(months))


def replay_policy(
    series: DataFrame, stock: DataFrame | None, best: DataFrame, classes: DataFrame, *, eval_months: int = 12,
    lead_time: int = 1, sigma: str | None = None, predictions: DataFrame | None = None,
) -> DataFrame:
    """Month by month what the policy would have ordered, served and lost.

    ``sigma`` names a column of ``best`` to use as the spread; otherwise it is the mean absolute change of the six
    months known at the time.
    """
    own = [F.greatest(F.lit(0.0), F.col(sigma)).alias("sigma")] if sigma else []
    packed = HI.pack(series, stock, predictions).join(best.select("product_id", "winner", *own), "product_id")
    packed = packed.join(policy_levels(classes.select("product_id", "abc")).select("product_id", "z_policy"), "product_id")
    start = F.greatest(F.lit(0), F.col("n") - 1 - _eval_months(F.col("n"), eval_months))
    packed = packed.withColumn("s0", HI.stock_at(start))
    spread = {} if sigma else {"sigma": HI.recent_change}
    rows = HI.each_month(packed, start + 1, {"forecast": HI.forecast_at, **spread}, ["product_id", "z_policy", "s0", *(["sigma"] if sigma else [])])
    rows = rows.withColumn("ss", F.col("z_policy") * F.col("sigma") * math.sqrt(float(lead_time)))
    out = _order_up_to(rows.withColumn("__T", F.col("forecast") + F.col("ss")), "__T", "")
    return out.withColumn("stockout", F.col("lost") > 0).select(
        "product_id", "month", "stock_start", "forecast", "sigma", "ss", "order", "demand", "served", "lost", "stock_end", "stockout"
    )


def replay_kpis(replay: DataFrame) -> DataFrame:
    d = F.sum("demand")
    return replay.groupBy("product_id").agg(
        F.count("*").alias("months"),
        F.count_if("stockout").alias("stockout_months"),
        F.when(d > 0, 100.0 * F.sum("served") / d).otherwise(F.lit(0.0)).alias("fill_rate_pct"),
        F.sum("lost").alias("lost_units"),
        F.avg("stock_end").alias("mean_stock"),
        F.sum("order").alias("total_order"),
    )


def replay_comparison(
    series: DataFrame, stock: DataFrame | None, best: DataFrame, *, eval_months: int = 12, lead_time: int = 1,
    cost_inventory: float = 1.0, cost_stockout: float = 5.0, test_months: int = 12, predictions: DataFrame | None = None,
) -> DataFrame:
    """Months as they would have gone without the system (order last month's demand) and with it, with costs."""
    start = F.greatest(F.lit(1), F.col("n") - 1 - _eval_months(F.col("n"), eval_months))
    packed = HI.pack(series, stock, predictions).join(best.select("product_id", "winner"), "product_id")
    packed = packed.withColumns({"sigma": HI.winner_error(test_months), "s0": HI.stock_at(start - 1)}).where(F.col("sigma").isNotNull())
    before = lambda i: F.get(F.col("demand"), i - 1)
    rows = HI.each_month(packed, start, {"prev_demand": before, "forecast": HI.forecast_at}, ["product_id", "winner", "sigma", "s0"])
    rows = rows.withColumn("sys_ss", safety_stock(newsvendor_z(cost_stockout, cost_inventory), F.col("sigma"), lead_time))
    rows = _repeat_last(rows, "base_")
    rows = _order_up_to(rows.withColumn("__T", F.col("forecast") + F.col("sys_ss")), "__T", "sys_")
    costs = {}
    for p in ("base", "sys"):
        costs[f"{p}_cost_inventory"] = F.col(f"{p}_stock_end") * cost_inventory
        costs[f"{p}_cost_stockout"] = F.col(f"{p}_lost") * cost_stockout
        costs[f"{p}_cost_total"] = costs[f"{p}_cost_inventory"] + costs[f"{p}_cost_stockout"]
    side = lambda p: [f"{p}_{c}" for c in ("stock_start", "order", "stock_end", "lost", "cost_inventory", "cost_stockout", "cost_total")]
    return rows.withColumns(costs).select(
        "product_id", "winner", "sigma", "month", "demand", *side("base"), F.col("forecast").alias("sys_forecast"), "sys_ss", *side("sys")
    )


def comparison_kpis(replay: DataFrame) -> DataFrame:
    """Both sides per product: stock-outs, fill rate, lost units, costs, and what the system saves."""
    d = F.sum("demand")
    aggs = [F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), d.alias("demand")]
    for p in ("base", "sys"):
        lost = F.sum(f"{p}_lost")
        aggs += [
            F.count_if(F.col(f"{p}_lost") > 0).alias(f"{p}_stockout_months"),
            F.when(d > 0, 100.0 * (d - lost) / d).otherwise(F.lit(0.0)).alias(f"{p}_fill_rate_pct"),
            lost.alias(f"{p}_lost"),
            F.sum(f"{p}_cost_total").alias(f"{p}_cost_total"),
            F.sum(f"{p}_cost_stockout").alias(f"{p}_cost_stockout"),
            F.sum(f"{p}_cost_inventory").alias(f"{p}_cost_inventory"),
            F.avg(f"{p}_stock_end").alias(f"{p}_mean_stock"),
        ]
    return replay.groupBy("product_id", "winner").agg(*aggs).withColumns(
        {
            "savings": F.col("base_cost_total") - F.col("sys_cost_total"),
            "fill_rate_gain_pp": F.col("sys_fill_rate_pct") - F.col("base_fill_rate_pct"),
            "lost_reduction": F.col("base_lost") - F.col("sys_lost"),
        }
    )


def portfolio_totals(kpis: DataFrame) -> DataFrame:
    d = F.sum("demand")
    sums = [F.count("*").alias("n_products"), d.alias("demand")]
    for p in ("base", "sys"):
        sums += [F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in ("lost", "cost_total", "cost_inventory", "cost_stockout")]
        sums.append(F.when(d > 0, (1 - F.sum(f"{p}_lost") / d) * 100).otherwise(F.lit(0.0)).alias(f"{p}_fill_rate_pct"))
    return kpis.agg(*sums, F.sum("savings").alias("savings"))


def top_savings(kpis: DataFrame, n: int = 30) -> DataFrame:
    return kpis.orderBy(F.desc(F.round("savings", 6)), "product_id").limit(n)


def prioritized(recommendations: DataFrame, n: int = 10) -> DataFrame:
    """Risk first, then most production, then most demand."""
    return recommendations.orderBy(F.desc("at_risk"), F.desc("production"), F.desc("total_demand"), "product_id").limit(n)


def recommendation_kpis(recommendations: DataFrame) -> DataFrame:
    return recommendations.agg(
        F.count("*").alias("n_products"), F.count_if("at_risk").alias("n_at_risk"),
        F.sum("production").alias("total_production"), F.avg("production").cast("bigint").alias("mean_production"),
    )
