"""ABC, indicators and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.operators import analytics as A
from demandry.operators import build as B
from demandry.operators import quality as Q
from demandry.plans import load
from demandry.session import materialize, sparing
from demandry.sources import tpch
from demandry.sources.tpch import PHYSICAL_CHANNELS, balanced_ledger, ledger
from suite import builders
from suite import common as C
from suite import twin as T
from suite.registry import each, query

_D = (T.LEDGER, T.DEMAND)


@query("abc_classes", T.chain(*_D, T.ABC) + " SELECT * FROM abc", each("share cum_share", 9))
def abc_classes(spark, sf):
    return A.abc(C.demand(spark, sf))


@query(
    "abc_by_organization",
    T.chain(T.LEDGER)
    + """, t AS (SELECT org_id, product_id, sum(qty) AS total FROM ledger WHERE kind = 'sale' GROUP BY org_id, product_id),
    c AS (SELECT *, total / sum(total) OVER (PARTITION BY org_id) AS share,
      sum(total) OVER (PARTITION BY org_id ORDER BY total DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY org_id) AS cum_share FROM t)
    SELECT *, CASE WHEN round(cum_share, 12) <= 0.8 THEN 'A' WHEN round(cum_share, 12) <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM c""",
    each("share cum_share", 9),
)
def abc_by_organization(spark, sf):
    d = B.demand_monthly(ledger(spark, sf, "org_id", "product_id", "month", "kind", "qty"), ["org_id", "product_id"])
    return A.abc(d, ["org_id"])


@query("products_of_class_a", T.chain(*_D, T.ABC) + " SELECT product_id FROM abc WHERE abc = 'A'")
def products_of_class_a(spark, sf):
    return A.product_list(A.abc(C.demand(spark, sf)), "A")


@query("class_counts", T.chain(*_D, T.ABC) + " SELECT abc, count(*) AS n_products, sum(total) AS total FROM abc GROUP BY abc")
def class_counts(spark, sf):
    return A.class_counts(A.abc(C.demand(spark, sf)))


@query(
    "dataset_kpis",
    T.chain(T.LEDGER)
    + """ SELECT count(DISTINCT product_id) AS n_products, count(DISTINCT CASE WHEN kind = 'sale' THEN month END) AS n_periods, count(*) FILTER (kind = 'sale') AS n_sales,
    count(*) FILTER (kind = 'production') AS n_productions, count(*) AS n_movements, min(month) AS first_month, max(month) AS last_month,
    count(DISTINCT channel) AS n_channels, count(DISTINCT client) AS n_clients, count(DISTINCT campaign) AS n_campaigns FROM ledger""",
)
def dataset_kpis(spark, sf):
    return A.dataset_kpis(ledger(spark, sf, "product_id", "month", "kind", "channel", "client", "campaign"))


_LAST = """, ranked_{t} AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS back FROM {t})"""


@query(
    "demand_kpis",
    T.chain(*_D, T.SERIES)
    + _LAST.replace("{t}", "series")
    + """, k AS (SELECT product_id, avg(demand) AS mean, max(demand) AS max, min(demand) AS min, stddev_samp(demand) AS std, max(CASE WHEN back = 1 THEN demand END) AS last,
      coalesce(max(CASE WHEN back = 2 THEN demand END), max(CASE WHEN back = 1 THEN demand END)) AS previous FROM ranked_series GROUP BY product_id)
    SELECT *, CASE WHEN previous <> 0 THEN (last - previous) / previous * 100 ELSE 0 END AS trend_pct, CASE WHEN mean <> 0 THEN (max - mean) / mean * 100 ELSE 0 END AS max_vs_mean_pct,
      CASE WHEN mean <> 0 THEN (min - mean) / mean * 100 ELSE 0 END AS min_vs_mean_pct FROM k""",
    each("mean std trend_pct max_vs_mean_pct min_vs_mean_pct", 6),
)
def demand_kpis(spark, sf):
    return A.demand_kpis(C.series(spark, sf))


@query(
    "component_shares",
    T.chain(T.LEDGER)
    + builders._COMPONENTS
    + """, s AS (SELECT product_id, sum(store_sale) AS a, sum(consumption) AS b, sum(external) AS c FROM components GROUP BY product_id)
    SELECT product_id, unnest(['store_sale', 'consumption', 'external']) AS component, unnest([a, b, c]) AS units,
      unnest([CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0 END, CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0 END, CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 0 END]) AS share FROM s""",
    each("share", 9),
)
def component_shares(spark, sf):
    return A.component_shares(builders.components(spark, sf))


@query(
    "stock_kpis",
    T.chain(*_D, T.STOCK)
    + _LAST.replace("{t}", "stock")
    + """, k AS (SELECT product_id, avg(stock) AS mean, max(stock) AS max, min(stock) AS min, max(CASE WHEN back = 1 THEN stock END) AS last,
      coalesce(max(CASE WHEN back = 2 THEN stock END), max(CASE WHEN back = 1 THEN stock END)) AS previous FROM ranked_stock GROUP BY product_id),
    u AS (SELECT CAST(date_diff('day', min(month), max(month) + INTERVAL 1 MONTH) AS DOUBLE) AS days FROM demand),
    j AS (SELECT k.*, coalesce(d.total / u.days, 1) AS daily_demand FROM k LEFT JOIN (SELECT product_id, sum(demand) AS total FROM demand GROUP BY product_id) d USING (product_id) CROSS JOIN u),
    m AS (SELECT *, last - previous AS change, CASE WHEN max <> 0 THEN last / max * 100 ELSE 0 END AS occupancy_pct, CASE WHEN daily_demand > 0 THEN last / daily_demand ELSE 0 END AS coverage_days FROM j)
    SELECT *, CASE WHEN occupancy_pct BETWEEN 30 AND 80 THEN 'optimal' WHEN occupancy_pct > 80 THEN 'review' ELSE 'low' END AS occupancy_status,
      CASE WHEN coverage_days >= 7 THEN 'good' WHEN coverage_days >= 3 THEN 'tight' ELSE 'critical' END AS coverage_status FROM m""",
    each("mean daily_demand occupancy_pct coverage_days", 6),
)
def stock_kpis(spark, sf):
    return A.stock_kpis(C.stock(spark, sf), C.demand(spark, sf))


@query(
    "stock_volatility",
    T.chain(T.LEDGER, T.STOCK)
    + """, k AS (SELECT product_id, avg(stock) AS mean, stddev_samp(stock) AS std, count(*) FILTER (stock < m) AS months_below_mean, count(*) AS n_months, max(stock) - min(stock) AS range
      FROM (SELECT *, avg(stock) OVER (PARTITION BY product_id) AS m FROM stock) GROUP BY product_id),
    c AS (SELECT *, CASE WHEN mean > 0 THEN std / mean * 100 ELSE 0 END AS cv_pct, 100.0::DOUBLE * months_below_mean / n_months AS below_pct FROM k)
    SELECT *, CASE WHEN cv_pct > 50 THEN 'high' WHEN cv_pct > 25 THEN 'moderate' ELSE 'stable' END AS status FROM c""",
    each("mean std cv_pct below_pct", 6),
)
def stock_volatility(spark, sf):
    return A.stock_volatility(C.stock(spark, sf))


@query(
    "top_products",
    T.chain(*_D) + " SELECT product_id, sum(demand) AS total, count(*) AS n_months, sum(demand) / count(*) AS per_month FROM demand GROUP BY product_id ORDER BY total DESC, product_id LIMIT 5",
    each("per_month", 6),
)
def top_products(spark, sf):
    return A.top_products(C.demand(spark, sf))


_LOW = T.ledger(opening=100)


@query(
    "negative_stock",
    T.chain(_LOW)
    + """, k AS (SELECT count(*) AS n_rows, min(stock_after) AS min_stock, max(stock_after) AS max_stock, avg(stock_after) AS mean_stock, count(*) FILTER (stock_after < 0) AS n_negative,
      min(stock_after) FILTER (stock_after < 0) AS min_negative, max(stock_after) FILTER (stock_after < 0) AS max_negative, avg(stock_after) FILTER (stock_after < 0) AS mean_negative,
      count(*) FILTER (stock_after < -100) AS n_below_100, count(*) FILTER (stock_after >= -100 AND stock_after < -10) AS n_100_to_10, count(*) FILTER (stock_after >= -10 AND stock_after < 0) AS n_above_10,
      count(DISTINCT product_id) FILTER (stock_after < 0) AS n_products_negative, quantile_cont(stock_after, 0.5) FILTER (stock_after < 0) AS median_negative FROM ledger)
    SELECT *, 100.0::DOUBLE * n_negative / n_rows AS negative_pct, CASE WHEN n_negative / n_rows > 0.1 THEN 'high' WHEN n_negative / n_rows > 0.02 THEN 'moderate' ELSE 'low' END AS verdict FROM k""",
    each("mean_stock mean_negative median_negative negative_pct", 6),
)
def negative_stock(spark, sf):
    return Q.negative_stock(balanced_ledger(spark, sf, opening=100.0))


@query("worst_balances", T.chain(_LOW) + " SELECT product_id, date, stock_after FROM ledger ORDER BY stock_after, product_id, date, ok, ln, pk, sk LIMIT 10")
def worst_balances(spark, sf):
    return Q.worst_balances(balanced_ledger(spark, sf, opening=100.0))


@query(
    "negative_stock_by_warehouse",
    T.chain(_LOW) + " SELECT warehouse, count(*) AS n_rows, count(*) FILTER (stock_after < 0) AS n_negative, 100.0::DOUBLE * count(*) FILTER (stock_after < 0) / count(*) AS negative_pct FROM ledger GROUP BY warehouse",
    each("negative_pct", 6),
)
def negative_stock_by_warehouse(spark, sf):
    return Q.negative_by_warehouse(balanced_ledger(spark, sf, "warehouse", opening=100.0))


def _constancy(keys: str, having: str = "") -> str:
    return T.chain(T.LEDGER) + f""" SELECT {keys}, count(*) AS n_rows, count(DISTINCT unit_cost) AS n_costs, min(unit_cost) AS min_cost, max(unit_cost) AS max_cost, count(DISTINCT unit_cost) <= 1 AS constant
      FROM ledger WHERE kind = 'production' GROUP BY {keys} {having}"""


@query("cost_constancy", _constancy("product_id"))
def cost_constancy(spark, sf):
    return Q.cost_constancy(ledger(spark, sf, "product_id", "kind", "unit_cost"), ["product_id"])


@query("cost_varying_by_day", _constancy("date, product_id", "HAVING count(DISTINCT unit_cost) > 1"))
def cost_varying_by_day(spark, sf):
    return Q.varying_costs(ledger(spark, sf, "date", "product_id", "kind", "unit_cost"), ["date", "product_id"])


@query("cost_varying_by_month", _constancy("month, product_id", "HAVING count(DISTINCT unit_cost) > 1"))
def cost_varying_by_month(spark, sf):
    return Q.varying_costs(ledger(spark, sf, "month", "product_id", "kind", "unit_cost"), ["month", "product_id"])


@query("cost_by_warehouse", _constancy("product_id, warehouse"))
def cost_by_warehouse(spark, sf):
    return Q.cost_constancy(ledger(spark, sf, "product_id", "warehouse", "kind", "unit_cost"), ["product_id", "warehouse"])


@query(
    "first_costs",
    T.chain(T.LEDGER)
    + """ SELECT product_id, unit_cost, n_rows, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY unit_cost) AS place FROM (
      SELECT product_id, unit_cost, count(*) AS n_rows FROM ledger WHERE kind = 'production' GROUP BY product_id, unit_cost)) WHERE place <= 3""",
)
def first_costs(spark, sf):
    return Q.first_costs(ledger(spark, sf, "product_id", "kind", "unit_cost"))


@query(
    "cost_statistics",
    T.chain(T.LEDGER)
    + """ SELECT product_id, min(unit_cost) AS min, max(unit_cost) AS max, avg(unit_cost) AS mean, stddev_samp(unit_cost) AS std,
    stddev_samp(unit_cost) / avg(unit_cost) * 100 AS cv_pct FROM ledger WHERE kind = 'production' GROUP BY product_id""",
    # More digits than the report's three: prices in cents over whole quantities often end in an exact half there.
    each("min max", 9) | each("mean std cv_pct", 5),
)
def cost_statistics(spark, sf):
    return Q.cost_stats(ledger(spark, sf, "product_id", "kind", "unit_cost"), digits=14)


@query("rows_per_day", "SELECT avg(n) AS mean, min(n) AS min, max(n) AS max, count(*) AS n_days FROM (SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1)", each("mean", 6))
def rows_per_day(spark, sf):
    return Q.rows_per_day(ledger(spark, sf, "date"))


@query("rows_per_month", T.chain(T.LEDGER) + " SELECT month, count(*) AS n FROM ledger GROUP BY month")
def rows_per_month(spark, sf):
    return Q.rows_per_month(ledger(spark, sf, "month"))


_SHOP = "coalesce(channel IN ('1-URGENT', '2-HIGH'), false)"


@query(
    "channel_pos_check",
    T.chain(T.LEDGER)
    + f""" SELECT count(*) FILTER (kind = 'sale' AND {_SHOP} AND pos IS NOT NULL) AS physical_with_pos, count(*) FILTER (kind = 'sale' AND {_SHOP} AND pos IS NULL) AS physical_without_pos,
    count(*) FILTER (kind = 'sale' AND NOT {_SHOP}) AS online, count(*) FILTER (kind = 'sale' AND NOT {_SHOP} AND pos IS NOT NULL) AS online_with_pos,
    count(*) FILTER (kind = 'production' AND pos IS NOT NULL) AS production_with_pos,
    100.0::DOUBLE * count(*) FILTER (kind = 'sale' AND {_SHOP} AND pos IS NOT NULL) / count(*) FILTER (kind = 'sale' AND {_SHOP}) AS with_pos_pct FROM ledger""",
    each("with_pos_pct", 6),
)
def channel_pos_check(spark, sf):
    return Q.channel_pos_check(ledger(spark, sf, "kind", "channel", "pos"), PHYSICAL_CHANNELS)


@query(
    "pos_shares",
    T.chain(T.LEDGER)
    + f""" SELECT pos, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM ledger WHERE kind = 'sale' AND {_SHOP}) AS pct FROM ledger
    WHERE kind = 'sale' AND {_SHOP} AND pos IS NOT NULL GROUP BY pos""",
    each("pct", 6),
)
def pos_shares(spark, sf):
    return Q.pos_shares(ledger(spark, sf, "kind", "channel", "pos"), PHYSICAL_CHANNELS)


def _by(kind: str, key: str) -> str:
    return T.chain(T.LEDGER) + f" SELECT {key}, count(*) AS n, sum(qty) AS units, avg(qty) AS mean_units, sum(total_value) AS value FROM ledger WHERE kind = '{kind}' GROUP BY {key}"


@query("sales_by_product", _by("sale", "product_id"), {"mean_units": 6, "value": 4})
def sales_by_product(spark, sf):
    return A.sales_by(ledger(spark, sf, "product_id", "kind", "qty", "total_value"), "sale", ["product_id"])


@query("production_by_product", _by("production", "product_id"), {"mean_units": 6, "value": 4})
def production_by_product(spark, sf):
    return A.sales_by(ledger(spark, sf, "product_id", "kind", "qty", "total_value"), "production", ["product_id"])


@query("sales_by_pos", _by("sale", "pos"), {"mean_units": 6, "value": 4})
def sales_by_pos(spark, sf):
    return A.sales_by(ledger(spark, sf, "pos", "kind", "qty", "total_value"), "sale", ["pos"])


@query("mean_stock", T.chain(T.LEDGER) + " SELECT product_id, avg(stock_after) AS mean_stock FROM ledger GROUP BY product_id", each("mean_stock", 6))
def mean_stock(spark, sf):
    return A.mean_stock(balanced_ledger(spark, sf))


_CORR = ["qty", "unit_price", "discount_pct", "total_value"]


@query(
    "correlations",
    T.chain(T.LEDGER) + " " + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS corr FROM ledger" for a in _CORR for b in _CORR),
    each("corr", 8),
)
def correlations(spark, sf):
    return A.correlations(ledger(spark, sf, *_CORR), _CORR)


@query(
    "whole_against_parts",
    T.chain(T.LEDGER) + " SELECT count(*) AS n_whole, count(*) FILTER (year < 2001 OR kind = 'sale') AS n_parts, count(*) FILTER (year = 2001 AND kind <> 'sale') AS n_missing, CAST(0 AS BIGINT) AS n_extra, true AS same_columns, true AS same_types FROM ledger",
)
def whole_against_parts(spark, sf):
    rows = ledger(spark, sf, "date", "year", "product_id", "kind", "qty", "doc", "row_seq")
    parts = [rows.where(F.col("year") == y) for y in range(1995, 2001)] + [rows.where((F.col("year") == 2001) & (F.col("kind") == "sale"))]
    return Q.whole_against_parts(rows, B.union_ledgers(parts))


@query("product_catalogue", T.chain(T.LEDGER) + " SELECT DISTINCT product_id, product_name FROM ledger")
def product_catalogue(spark, sf):
    return A.product_catalogue(ledger(spark, sf, "product_id", "product_name"))


@query(
    "kind_mix",
    T.chain(T.LEDGER)
    + """ SELECT kind, count(*) AS n_rows, count(*) FILTER (qty > 0) AS n_positive, count(*) FILTER (qty < 0) AS n_negative, count(*) FILTER (qty = 0) AS n_zero,
    min(qty) AS min_qty, max(qty) AS max_qty, avg(qty) AS mean_qty, stddev_samp(qty) AS std_qty, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM ledger) AS pct FROM ledger GROUP BY kind""",
    each("mean_qty std_qty pct", 6),
)
def kind_mix(spark, sf):
    return Q.kind_mix(ledger(spark, sf, "kind", "qty"))


_PROFILE = {"product_id": "text", "kind": "text", "channel": "text", "pos": "text", "unit_price": "numeric", "unit_cost": "numeric", "date": "other", "year": "numeric"}


@query(
    "column_profile",
    T.chain(T.LEDGER)
    + " "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS family, count({c}) AS n_filled, count(*) - count({c}) AS n_missing FROM ledger" for c, k in _PROFILE.items()),
)
def column_profile(spark, sf):
    return Q.column_profile(ledger(spark, sf, *_PROFILE))


_RULES = {
    "sale_has_no_cost": "kind = 'sale' AND unit_cost IS NOT NULL", "sale_has_price": "kind = 'sale' AND unit_price IS NULL",
    "sale_has_client": "kind = 'sale' AND client IS NULL", "production_has_cost": "kind = 'production' AND unit_cost IS NULL",
    "production_has_no_client": "kind = 'production' AND client IS NOT NULL", "production_has_no_price": "kind = 'production' AND unit_price IS NOT NULL",
    "production_has_no_pos": "kind = 'production' AND pos IS NOT NULL",
}


@query("null_rules", T.chain(T.LEDGER) + " " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({c}) AS n_broken FROM ledger" for r, c in _RULES.items()))
def null_rules(spark, sf):
    return Q.null_rules(ledger(spark, sf, "kind", "unit_cost", "unit_price", "client", "pos"))


@query(
    "stage_counts",
    T.chain(*_D)
    + """, kept AS (SELECT * FROM ledger WHERE ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0)
    SELECT 0 AS position, 'read' AS stage, count(*) AS n_rows FROM ledger UNION ALL SELECT 1, 'clean', count(*) FROM kept
    UNION ALL SELECT 2, 'demand', count(*) FROM (SELECT DISTINCT product_id, month FROM kept WHERE kind = 'sale') UNION ALL SELECT 3, 'stock', count(*) FROM (SELECT DISTINCT product_id, month FROM kept)""",
)
def stage_counts(spark, sf):
    # What the ledger was made from goes; it and its clean rows are read by the counts.
    with sparing(spark) as sources:
        raw = materialize(tpch.raw_ledger(spark, sf, places=True), "raw")
        sources.pop()
    with sparing(spark) as kept:
        r = load.monthly_tables(raw, keep=True)
        kept.clear()
    return Q.stage_counts({"read": raw, "clean": r.movements, "demand": r.demand_monthly, "stock": r.stock_monthly})


@query(
    "year_flow",
    T.chain(_LOW)
    + """ SELECT year, count(*) AS n_rows, 100.0::DOUBLE * count(*) FILTER (stock_after < 0) / count(*) AS negative_pct, min(stock_after) AS min_stock, max(stock_after) AS max_stock,
    sum(in_units) AS units_in, sum(out_units) AS units_out, CASE WHEN sum(in_units) > 0 THEN sum(out_units) / sum(in_units) ELSE 0 END AS out_in_ratio FROM ledger GROUP BY year""",
    each("negative_pct out_in_ratio", 6),
)
def year_flow(spark, sf):
    return Q.year_flow(balanced_ledger(spark, sf, "year", "in_units", "out_units", opening=100.0))


@query("rows_per_year", T.chain(T.LEDGER) + " SELECT year, count(*) AS n_rows, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM ledger) AS pct FROM ledger GROUP BY year", each("pct", 6))
def rows_per_year(spark, sf):
    return Q.rows_per_year(ledger(spark, sf, "year"))
