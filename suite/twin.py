"""Shared parts of the SQL twins: the ledger view and the tables built on it."""

from __future__ import annotations

import re


def ledger(opening: int = 10_000, brand: bool = False, org: bool = False) -> str:
    product = "p_brand" if brand else "CAST(l_partkey AS VARCHAR)"
    if org:
        product = f"'org' || CAST(l_suppkey % 5 AS VARCHAR) || chr(31) || {product}"
    return f"""
base AS (
  SELECT 'org' || CAST(l_suppkey % 5 AS VARCHAR) AS org_id,
    CAST(l_shipdate AS DATE) AS date, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month_no, CAST(day(l_shipdate) AS INTEGER) AS day,
    {product} AS product_id, p_brand AS brand, p_name AS product_name, p_type AS product_type,
    CASE WHEN l_returnflag <> 'R' THEN 'sale' ELSE 'production' END AS kind, l_quantity AS qty,
    CASE WHEN l_returnflag <> 'R' THEN -l_quantity ELSE l_quantity END AS signed,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / l_quantity END AS unit_price,
    CASE WHEN l_returnflag <> 'R' THEN 100 * l_discount END AS discount_pct,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS total_value,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice / l_quantity END AS unit_cost,
    CASE l_linenumber % 3 WHEN 0 THEN 'VO' WHEN 1 THEN 'CO' ELSE 'GU' END AS doc, CAST(l_suppkey % 3 AS VARCHAR) AS doc_no,
    CASE WHEN l_returnflag <> 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS in_units,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0::DOUBLE END AS out_units,
    'W' || CAST(s_nationkey AS VARCHAR) AS warehouse,
    CASE WHEN l_returnflag <> 'R' THEN o_orderpriority END AS channel,
    CASE WHEN l_returnflag <> 'R' AND ((o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_linenumber <> 7)
      OR (o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND l_orderkey % 101 = 0)) THEN 'POS ' || CAST(l_suppkey % 2 + 1 AS VARCHAR) END AS pos,
    CASE WHEN l_returnflag <> 'R' THEN c_name END AS client,
    CASE WHEN l_returnflag <> 'R' THEN c_mktsegment END AS campaign,
    CASE WHEN l_returnflag <> 'R' THEN n_name END AS department,
    l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
),
ledger AS (
  SELECT *, run + {opening} AS stock_after, run + {opening} - signed AS stock_before FROM (
    SELECT *, sum(signed) OVER (PARTITION BY product_id ORDER BY date, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) AS run FROM base)
)"""


LEDGER = ledger()
BRANDS = ledger(brand=True)

DEMAND = """
demand AS (SELECT product_id, month, abs(sum(qty)) AS demand FROM ledger WHERE kind = 'sale' GROUP BY product_id, month)"""

STOCK = """
stock AS (
  SELECT product_id, month, stock_after AS stock FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, month ORDER BY date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS rn FROM ledger)
  WHERE rn = 1)"""

SERIES = """
bounds AS (SELECT min(month) AS a, max(month) AS b FROM demand),
months AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds),
series AS (
  SELECT p.product_id, m.month, coalesce(d.demand, 0.0) AS demand
  FROM (SELECT DISTINCT product_id FROM demand) p CROSS JOIN months m
  LEFT JOIN demand d ON d.product_id = p.product_id AND d.month = m.month)"""

COLUMNS = """
cols AS (
  SELECT product_id, month, demand,
    count(*) OVER (PARTITION BY product_id) AS n,
    row_number() OVER w - 1 AS pos,
    lag(demand, 1) OVER w AS p_naive,
    coalesce(lag(demand, 12) OVER w, lag(demand, 1) OVER w) AS p_seasonal,
    avg(demand) OVER (PARTITION BY product_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p_ma3,
    avg(demand) OVER (PARTITION BY product_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS p_ma6,
    lag(demand, 1) OVER w AS prev_demand
  FROM series WINDOW w AS (PARTITION BY product_id ORDER BY month))"""


def predictions(horizon: str = "12") -> str:
    return f"""
preds AS (
  SELECT product_id, month, model, demand AS y_true, y_pred FROM (
    SELECT product_id, month, demand, unnest(['Naive', 'Seasonal12', 'MA3', 'MA6']) AS model,
      unnest([p_naive, p_seasonal, p_ma3, p_ma6]) AS y_pred
    FROM cols WHERE n >= 3 AND pos >= greatest(1, n - {horizon})))"""


METRICS = """
scores AS (
  SELECT product_id, model, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
    100 * avg(2 * abs(y_true - y_pred) / greatest(abs(y_true) + abs(y_pred), 1e-9)) AS smape_pct,
    100 * avg(abs(y_true - y_pred) / greatest(abs(y_true), 1e-9)) AS mape_safe_pct, count(*) AS n
  FROM preds GROUP BY product_id, model)"""

CHOSEN = """
windows AS (
  SELECT product_id, CASE WHEN m3 < m6 THEN 3 ELSE 6 END AS ma_window, m3 AS mae_set3, m6 AS mae_set6 FROM (
    SELECT product_id, min(CASE WHEN model <> 'MA6' THEN round(mae, 9) END) AS m3, min(CASE WHEN model <> 'MA3' THEN round(mae, 9) END) AS m6
    FROM scores GROUP BY product_id)),
chosen AS (
  SELECT s.* FROM scores s JOIN windows w ON s.product_id = w.product_id
  WHERE model NOT IN ('MA3', 'MA6') OR model = 'MA' || CAST(ma_window AS VARCHAR))"""


def ranked(source: str, by: str = "mae") -> str:
    place = "CASE model WHEN 'Naive' THEN 0 WHEN 'Seasonal12' THEN 1 WHEN 'MA3' THEN 2 ELSE 3 END"
    return f"""
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY round({by}, 9), round(mae, 9), {place}) AS INTEGER) AS rank FROM {source})"""


BEST = """
best AS (SELECT product_id, model AS winner, mae, rmse, smape_pct, mape_safe_pct, n FROM ranked WHERE rank = 1)"""

ABC = """
totals AS (SELECT product_id, sum(demand) AS total FROM demand GROUP BY product_id),
abc AS (
  SELECT product_id, total, share, cum_share, CASE WHEN round(cum_share, 12) <= 0.8 THEN 'A' WHEN round(cum_share, 12) <= 0.95 THEN 'B' ELSE 'C' END AS abc
  FROM (SELECT product_id, total, total / sum(total) OVER () AS share,
    sum(total) OVER (ORDER BY total DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS cum_share FROM totals))"""

AHEAD = """
newest AS (SELECT product_id, month, demand, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS back FROM series),
ends AS (
  SELECT product_id, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS month, max(CASE WHEN back = 1 THEN demand END) AS f_naive,
    coalesce(max(CASE WHEN back = 12 THEN demand END), max(CASE WHEN back = 1 THEN demand END)) AS f_seasonal,
    avg(CASE WHEN back <= 3 THEN demand END) AS f_ma3, avg(CASE WHEN back <= 6 THEN demand END) AS f_ma6
  FROM newest GROUP BY product_id),
ahead AS (
  SELECT product_id, month, unnest(['Naive', 'Seasonal12', 'MA3', 'MA6']) AS model,
    unnest([greatest(f_naive, 0), greatest(f_seasonal, 0), greatest(f_ma3, 0), greatest(f_ma6, 0)]) AS forecast FROM ends)"""


# Parts that several others of a chain read: worked out once.
_SHARED = re.compile(r"^(\s*)(ledger|series|cols|preds|scores)((?:\([^)]*\))? AS) \(", re.MULTILINE)


def shared(part: str) -> str:
    return _SHARED.sub(r"\1\2\3 MATERIALIZED (", part)


def chain(*parts: str) -> str:
    return "WITH " + ",".join(map(shared, parts))


FORECAST = (LEDGER, DEMAND, SERIES, COLUMNS, predictions(), METRICS)

# The same parts where products are told apart by organization.
_SCOPE = "split_part({}, chr(31), 1)"
SERIES_BY_ORG = f"""
bounds AS (SELECT {_SCOPE.format("product_id")} AS o, min(month) AS a, max(month) AS b FROM demand GROUP BY 1),
months AS (SELECT o, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds),
series AS (
  SELECT p.product_id, m.month, coalesce(d.demand, 0.0) AS demand
  FROM (SELECT DISTINCT product_id FROM demand) p JOIN months m ON m.o = {_SCOPE.format("p.product_id")}
  LEFT JOIN demand d ON d.product_id = p.product_id AND d.month = m.month)"""
ABC_BY_ORG = ABC.replace("OVER ()", f"OVER (PARTITION BY {_SCOPE.format('product_id')})").replace(
    "OVER (ORDER BY total DESC", f"OVER (PARTITION BY {_SCOPE.format('product_id')} ORDER BY total DESC"
).replace("ORDER BY total DESC, product_id", f"ORDER BY total DESC, {_SCOPE.format('product_id').replace(', 1)', ', 2)')}")


def by_org(sql: str, opening: int = 10_000) -> str:
    """A twin by product as one by organization and product."""
    for old, new in ((ledger(opening), ledger(opening, org=True)), (SERIES, SERIES_BY_ORG), (ABC, ABC_BY_ORG)):
        sql = sql.replace(shared(old), shared(new))
    return f"SELECT {_SCOPE.format('product_id')} AS org_id, * REPLACE (split_part(product_id, chr(31), 2) AS product_id) FROM ({sql}) q"
