"""SQL over registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.operators import sqlapi as A
from demandry.sources.tpch import ledger
from suite import twin as T
from suite.registry import each, query


def _years(spark, sf, *columns):
    rows = ledger(spark, sf, "year", *columns)
    A.register({f"data_{y}": rows.where(F.col("year") == y) for y in range(1995, 2002)})
    return rows


_Y = T.chain(T.LEDGER)


@query("adhoc_sql", _Y + " SELECT product_id, kind, count(*) AS n, sum(qty) AS qty FROM ledger WHERE year = 1998 AND qty > 10 GROUP BY product_id, kind")
def adhoc_sql(spark, sf):
    _years(spark, sf, "product_id", "kind", "qty")
    return A.query(spark, "SELECT product_id, kind, count(*) AS n, sum(qty) AS qty FROM data_1998 WHERE qty > :least GROUP BY product_id, kind", least=10)


@query(
    "aggregate_by_columns",
    _Y + " SELECT month_no, kind, sum(qty) AS qty_sum, avg(total_value) AS total_value_avg, count(product_id) AS product_id_count, max(date) AS date_max FROM ledger GROUP BY month_no, kind",
    each("total_value_avg", 4),
)
def aggregate_by_columns(spark, sf):
    rows = ledger(spark, sf, "month_no", "kind", "qty", "total_value", "product_id", "date")
    return A.aggregate(rows, ["month_no", "kind"], {"qty": "sum", "total_value": "avg", "product_id": "count", "date": "max"})


@query(
    "numeric_statistics",
    _Y
    + """, v AS (SELECT unnest(['qty', 'unit_price', 'discount_pct', 'total_value', 'month_no']) AS "column", unnest([qty, unit_price, discount_pct, total_value, CAST(month_no AS DOUBLE)]) AS value FROM ledger)
    SELECT "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
    quantile_cont(value, 0.75) AS p75, max(value) AS max FROM v WHERE value IS NOT NULL GROUP BY "column" """,
    each("mean std min max p25 p50 p75", 5),
)
def numeric_statistics(spark, sf):
    return A.describe_numeric(ledger(spark, sf, "product_id", "qty", "unit_price", "discount_pct", "total_value", "month_no"))


@query(
    "month_rollup_sql",
    _Y + " SELECT year, month_no, count(*) AS n, sum(qty) AS total, avg(qty) AS mean, max(qty) AS max FROM ledger GROUP BY year, month_no",
    each("mean", 6),
)
def month_rollup_sql(spark, sf):
    A.register({"movements": ledger(spark, sf, "year", "month_no", "qty")})
    return A.query(spark, "SELECT year, month_no, count(*) AS n, sum(qty) AS total, avg(qty) AS mean, max(qty) AS max FROM movements GROUP BY year, month_no ORDER BY year DESC, month_no DESC")


@query(
    "year_comparison_sql",
    _Y + " SELECT year, avg(qty) AS mean_qty, avg(unit_price) AS mean_price, sum(qty) AS total FROM ledger GROUP BY year",
    {"mean_qty": 2, "mean_price": 2},
)
def year_comparison_sql(spark, sf):
    _years(spark, sf, "qty", "unit_price")
    union = " UNION ALL ".join(f"SELECT * FROM data_{y}" for y in range(1995, 2002))
    return A.query(spark, f"SELECT year, avg(qty) AS mean_qty, avg(unit_price) AS mean_price, sum(qty) AS total FROM ({union}) GROUP BY year ORDER BY year")


@query(
    "ranked_revenue",
    _Y
    + """ SELECT ok, ln, pk, sk, month_no, qty, qty * unit_price AS revenue, row_number() OVER (PARTITION BY month_no ORDER BY qty DESC, ok, ln, pk, sk) AS rank_in_month
    FROM ledger WHERE kind = 'sale'""",
    each("revenue", 4),
)
def ranked_revenue(spark, sf):
    rows = ledger(spark, sf, "month_no", "kind", "qty", "unit_price", "row_seq").where(F.col("kind") == "sale")
    rows = rows.withColumn("revenue", F.col("qty") * F.col("unit_price"))
    out = A.rank_within(rows, ["month_no"], [F.desc("qty"), F.asc("row_seq")], "rank_in_month")
    key = {"ok": "l_orderkey", "ln": "l_linenumber", "pk": "l_partkey", "sk": "l_suppkey"}
    return out.select(*[F.col(f"row_seq.{c}").alias(a) for a, c in key.items()], "month_no", "qty", "revenue", "rank_in_month")


@query("preview_rows", _Y + " SELECT product_id, date, kind, qty FROM ledger ORDER BY date, ok, ln, pk, sk LIMIT 100")
def preview_rows(spark, sf):
    rows = ledger(spark, sf, "product_id", "date", "kind", "qty", "row_seq")
    return A.preview(rows, [F.col("date"), F.col("row_seq")], 100).select("product_id", "date", "kind", "qty")


@query(
    "join_sql",
    "SELECT p_partkey, p_name, p_brand, l_orderkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey",
)
def join_sql(spark, sf):
    from demandry.sources.tpch import table

    A.register({"part_t": table(spark, sf, "part"), "line_t": table(spark, sf, "lineitem")})
    return A.query(spark, "SELECT p_partkey, p_name, p_brand, l_orderkey, l_quantity FROM line_t JOIN part_t ON l_partkey = p_partkey")


@query("filtered_sum_sql", _Y + " SELECT sum(qty) AS total, count(*) AS n FROM ledger WHERE month_no = 1 AND year = 1998")
def filtered_sum_sql(spark, sf):
    A.register({"movements": ledger(spark, sf, "year", "month_no", "qty")})
    return A.query(spark, "SELECT sum(qty) AS total, count(*) AS n FROM movements WHERE month_no = 1 AND year = 1998")


@query("sum_by_month_sql", _Y + " SELECT month, sum(qty) AS total FROM ledger GROUP BY month")
def sum_by_month_sql(spark, sf):
    A.register({"movements": ledger(spark, sf, "month", "qty")})
    return A.query(spark, "SELECT month, sum(qty) AS total FROM movements GROUP BY month")
