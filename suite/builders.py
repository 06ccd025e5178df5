"""Monthly tables and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.operators import build as B
from demandry.plans import load
from demandry.sources import tpch
from demandry.sources.tpch import balanced_ledger, ledger
from suite import common as C
from suite import twin as T
from suite.registry import each, query


@query("demand_monthly", T.chain(T.LEDGER, T.DEMAND) + " SELECT * FROM demand")
def demand_monthly(spark, sf):
    return C.demand(spark, sf)


@query("stock_monthly", T.chain(T.LEDGER, T.STOCK) + " SELECT * FROM stock")
def stock_monthly(spark, sf):
    return C.stock(spark, sf)


@query(
    "stock_monthly_by_warehouse",
    T.chain(T.LEDGER)
    + """, bal AS (SELECT *, sum(in_units - out_units) OVER (PARTITION BY product_id, warehouse ORDER BY date, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) AS b FROM base)
    SELECT product_id, warehouse, month, b AS stock FROM bal
    QUALIFY row_number() OVER (PARTITION BY product_id, warehouse, month ORDER BY date DESC, ok DESC, ln DESC, pk DESC, sk DESC) = 1""",
)
def stock_monthly_by_warehouse(spark, sf):
    rows = ledger(spark, sf, "product_id", "warehouse", "date", "month", "in_units", "out_units", "row_block", "row_seq")
    bal = B.warehouse_balance(rows).withColumnRenamed("balance", "stock_after")
    return B.stock_monthly(bal, ["product_id", "warehouse"])


_GUIDES = """, g AS (
  SELECT *, sum(out_units) OVER k AS so, sum(in_units) OVER k AS si FROM ledger WHERE doc = 'GU'
  WINDOW k AS (PARTITION BY doc, doc_no, product_id, month)),
rec AS (
  SELECT product_id, month, doc, doc_no, ok, ln, pk, sk, in_units, out_units, 'NO_GUIA' AS guide_type, 0.0::DOUBLE AS external_units FROM ledger WHERE doc <> 'GU'
  UNION ALL
  SELECT product_id, month, doc, doc_no, ok, ln, pk, sk, in_units, out_units, CASE WHEN so > 0 AND si <= 0 THEN 'VENTA_EXTERNA' ELSE 'TRANSFERENCIA_INTERNA' END,
    CASE WHEN so > 0 AND si <= 0 THEN {share} ELSE 0.0 END FROM g)"""
_REC = _GUIDES.replace("{share}", "greatest(out_units, 0.0)")
_REC_WHOLE = _GUIDES.replace("{share}", "so")


def _reconciled(spark, sf, prorate=True):
    rows = ledger(spark, sf, "product_id", "month", "doc", "doc_no", "in_units", "out_units", "row_seq", by_brand=True)
    return B.reconcile_guides(rows, prorate=prorate)


_GUIDE_OUT = """ SELECT doc, doc_no, product_id, month, guide_type, count(*) AS n_rows, sum(out_units) AS out_units, sum(external_units) AS external_units
  FROM rec GROUP BY doc, doc_no, product_id, month, guide_type"""


def _guide_sums(df):
    return df.groupBy("doc", "doc_no", "product_id", "month", "guide_type").agg(
        F.count("*").alias("n_rows"), F.sum("out_units").alias("out_units"), F.sum("external_units").alias("external_units")
    )


@query(
    "guide_rows",
    T.chain(T.BRANDS) + _REC + " SELECT ok, ln, pk, sk, product_id, month, doc, doc_no, guide_type, external_units FROM rec",
)
def guide_rows(spark, sf):
    out = _reconciled(spark, sf)
    key = {"ok": "l_orderkey", "ln": "l_linenumber", "pk": "l_partkey", "sk": "l_suppkey"}
    return out.select(
        *[F.col(f"row_seq.{c}").alias(a) for a, c in key.items()], "product_id", "month", "doc", "doc_no", "guide_type", "external_units"
    )


@query("guide_totals", T.chain(T.BRANDS) + _REC + _GUIDE_OUT)
def guide_totals(spark, sf):
    return _guide_sums(_reconciled(spark, sf))


@query("guide_totals_unprorated", T.chain(T.BRANDS) + _REC_WHOLE + _GUIDE_OUT)
def guide_totals_unprorated(spark, sf):
    return _guide_sums(_reconciled(spark, sf, prorate=False))


@query("complete_series", T.chain(T.LEDGER, T.DEMAND, T.SERIES) + " SELECT * FROM series")
def complete_series(spark, sf):
    return C.series(spark, sf)


@query(
    "complete_series_between",
    T.chain(T.LEDGER, T.DEMAND)
    + """, m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-06-01', TIMESTAMP '1997-03-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT p.product_id, m.month, coalesce(d.demand, 0.0) AS demand FROM (SELECT DISTINCT product_id FROM demand) p CROSS JOIN m
    LEFT JOIN demand d ON d.product_id = p.product_id AND d.month = m.month""",
)
def complete_series_between(spark, sf):
    return B.complete_series(C.demand(spark, sf), start="1994-06-01", end="1997-03-01")


_COMPONENTS = _REC + """, mo AS (
  SELECT product_id, month, sum(CASE WHEN doc = 'VO' THEN out_units ELSE 0 END) AS store_sale, sum(CASE WHEN doc = 'CO' THEN out_units ELSE 0 END) AS consumption,
    sum(CASE WHEN guide_type = 'VENTA_EXTERNA' THEN external_units ELSE 0 END) AS external FROM rec GROUP BY product_id, month),
span AS (SELECT product_id, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM mo GROUP BY product_id),
components AS (
  SELECT s.product_id, s.month, coalesce(store_sale, 0.0) AS store_sale, coalesce(consumption, 0.0) AS consumption, coalesce(external, 0.0) AS external,
    coalesce(store_sale, 0.0) + coalesce(consumption, 0.0) + coalesce(external, 0.0) AS demand
  FROM span s LEFT JOIN mo ON mo.product_id = s.product_id AND mo.month = s.month)"""


def components(spark, sf):
    rows = ledger(spark, sf, "product_id", "month", "doc", "doc_no", "in_units", "out_units", "row_seq")
    return B.demand_components(B.reconcile_guides(rows), ["VO"], ["CO"])


@query("demand_components", T.chain(T.LEDGER) + _COMPONENTS + " SELECT * FROM components")
def demand_components(spark, sf):
    return components(spark, sf)


@query(
    "demand_by_client",
    T.chain(T.LEDGER) + " SELECT product_id, client, month, sum(qty) AS demand, sum(total_value) AS total_value FROM ledger WHERE kind = 'sale' GROUP BY product_id, client, month",
    each("total_value", 4),
)
def demand_by_client(spark, sf):
    return B.demand_by_client(ledger(spark, sf, "product_id", "client", "month", "kind", "qty", "total_value"))


@query(
    "demand_with_value",
    T.chain(T.LEDGER)
    + """ SELECT product_id, month, sum(qty) AS demand, sum(total_value) AS total_value, avg(discount_pct) AS mean_discount
    FROM ledger WHERE kind = 'sale' GROUP BY product_id, month""",
    {"total_value": 4, "mean_discount": 6},
)
def demand_with_value(spark, sf):
    return B.demand_with_value(ledger(spark, sf, "product_id", "month", "kind", "qty", "total_value", "discount_pct"))


@query(
    "stock_with_average",
    T.chain(T.LEDGER, T.STOCK)
    + """, m AS (SELECT product_id, month, avg(stock_after) AS mean_stock FROM ledger GROUP BY product_id, month)
    SELECT stock.product_id, stock.month, stock, mean_stock FROM stock JOIN m ON m.product_id = stock.product_id AND m.month = stock.month""",
    each("mean_stock", 6),
)
def stock_with_average(spark, sf):
    return B.stock_with_average(balanced_ledger(spark, sf))


@query(
    "demand_of_named_products",
    T.chain(T.LEDGER, T.DEMAND)
    + " SELECT * FROM demand WHERE product_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE lower(p_name) LIKE '%widget%')",
)
def demand_of_named_products(spark, sf):
    products = tpch.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"))
    return B.product_demand(C.demand(spark, sf), products, "Widget")


@query(
    "load_to_demand",
    T.chain(T.LEDGER)
    + """, kept AS (SELECT * FROM ledger WHERE ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0)
    SELECT product_id, month, abs(sum(qty)) AS demand FROM kept WHERE kind = 'sale' GROUP BY product_id, month""",
)
def load_to_demand(spark, sf):
    return load.monthly_tables(tpch.raw_ledger(spark, sf)).demand_monthly


@query(
    "load_to_stock",
    T.chain(T.LEDGER)
    + """ SELECT product_id, month, stock_after AS stock FROM ledger WHERE ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0
    QUALIFY row_number() OVER (PARTITION BY product_id, month ORDER BY date DESC, ok DESC, ln DESC, pk DESC, sk DESC) = 1""",
)
def load_to_stock(spark, sf):
    raw = tpch.raw_ledger(spark, sf, places=True)
    return load.monthly_tables(raw).stock_monthly


@query(
    "demand_groupings",
    T.chain(T.LEDGER)
    + """ SELECT CASE WHEN grouping(channel) = 0 THEN 'channel' WHEN grouping(campaign) = 0 THEN 'campaign' ELSE 'product' END AS level,
    coalesce(channel, campaign, product_id) AS value, count(qty) AS n, sum(qty) AS total, avg(qty) AS mean, stddev_samp(qty) AS std, min(qty) AS min, max(qty) AS max
    FROM ledger WHERE kind = 'sale' GROUP BY GROUPING SETS ((channel), (campaign), (product_id))""",
    each("mean std", 6),
)
def demand_groupings(spark, sf):
    return B.demand_groupings(ledger(spark, sf, "channel", "campaign", "product_id", "qty", "kind"))


@query(
    "union_of_years",
    T.chain(T.LEDGER) + " SELECT year, kind, count(*) AS n_rows, sum(qty) AS qty FROM ledger GROUP BY year, kind",
)
def union_of_years(spark, sf):
    rows = ledger(spark, sf, "year", "kind", "qty", "doc")
    years = range(1995, 2002)  # all years of the tables; the later ones lack a column
    parts = [rows.where(F.col("year") == y) if y < 1998 else rows.where(F.col("year") == y).drop("doc") for y in years]
    return B.union_ledgers(parts).groupBy("year", "kind").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("qty"))


@query(
    "warehouse_balance",
    T.chain(T.LEDGER)
    + """ SELECT ok, ln, pk, sk, product_id, warehouse, date,
    500 + sum(in_units - out_units) OVER (PARTITION BY product_id, warehouse ORDER BY date, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) AS balance FROM base""",
)
def warehouse_balance(spark, sf):
    rows = ledger(spark, sf, "product_id", "warehouse", "date", "month", "in_units", "out_units", "row_block", "row_seq")
    key = {"ok": "l_orderkey", "ln": "l_linenumber", "pk": "l_partkey", "sk": "l_suppkey"}
    return B.warehouse_balance(rows, 500.0).select(*[F.col(f"row_seq.{c}").alias(a) for a, c in key.items()], "product_id", "warehouse", "date", "balance")
