"""Safety stock, recommendations and policy replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.functions.columns import month_name, newsvendor_z, newsvendor_z_of, z_of_service_level
from demandry.operators import analytics as A
from demandry.operators import build as B
from demandry.operators import forecast as FC
from demandry.operators import policy as P
from demandry.operators import tenancy as N
from demandry.plans import choose
from demandry.sources import tpch
from suite import common as C
from suite import twin as T
from suite.registry import each, query

_Z = repr(newsvendor_z(5.0, 1.0))
_SERIES = (T.LEDGER, T.DEMAND, T.SERIES, T.COLUMNS)
_BEST = (*T.FORECAST, T.CHOSEN, T.ranked("chosen"), T.BEST)
_LEVEL = "CASE abc WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.9 ELSE 0.85 END::DOUBLE"
_ZPOL = "CASE abc WHEN 'A' THEN 1.65 WHEN 'B' THEN 1.28 ELSE 1.04 END::DOUBLE"


@query("policy_levels", T.chain(T.LEDGER, T.DEMAND, T.ABC) + f" SELECT product_id, abc, {_LEVEL} AS service_level, {_ZPOL} AS z_policy FROM abc")
def policy_levels(spark, sf):
    return P.policy_levels(A.abc(C.demand(spark, sf))).select("product_id", "abc", "service_level", "z_policy")


@query(
    "nearest_z",
    """WITH t AS (SELECT * FROM (VALUES (0.85, 1.04, 0), (0.9, 1.28, 1), (0.95, 1.65, 2), (0.975, 1.96, 3), (0.99, 2.33, 4)) v(l, z, i))
    SELECT p_partkey, level, CAST(z AS DOUBLE) AS z FROM (SELECT p_partkey, round(0.8 + p_size / 250.0::DOUBLE, 6) AS level FROM part) p JOIN t ON true
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(CAST(l AS DOUBLE) - level), i) = 1""",
)
def nearest_z(spark, sf):
    rows = tpch.table(spark, sf, "part").select("p_partkey", F.round(0.8 + F.col("p_size") / 250.0, 6).alias("level"))
    return rows.withColumn("z", z_of_service_level("level"))


# The normal distribution function by its series: odd powers of z over double factorials.
_CDF = """0.5 + sign(mid) * exp(-mid * mid / 2) / sqrt(2 * pi())
      * list_sum(list_transform(range(70), lambda k: exp((2 * k + 1) * ln(greatest(abs(mid), 1e-12)) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1))))"""


@query(
    "newsvendor_by_product",
    f"""WITH RECURSIVE p AS (SELECT p_partkey, p_retailprice / 100 AS cs, p_size / 5.0::DOUBLE AS ci FROM part),
    q AS (SELECT p_partkey, least(greatest(cs / (cs + ci), 0.001), 0.999) AS r FROM p),
    halves AS (  -- the quantile by bisection
      SELECT p_partkey, r, -4.0::DOUBLE AS lo, 4.0::DOUBLE AS hi, 0.0::DOUBLE AS mid, 0 AS i FROM q
      UNION ALL
      SELECT p_partkey, r, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, ((CASE WHEN below THEN mid ELSE lo END) + (CASE WHEN below THEN hi ELSE mid END)) / 2, i + 1
      FROM (SELECT *, {_CDF} < r AS below FROM halves WHERE i < 48))
    SELECT p_partkey, r AS critical_ratio, mid AS z FROM halves WHERE i = 48""",
    each("critical_ratio", 9) | each("z", 6),
)
def newsvendor_by_product(spark, sf):
    cs, ci = F.col("p_retailprice") / 100, F.col("p_size") / 5.0
    rows = tpch.table(spark, sf, "part").select("p_partkey", cs.alias("cs"), ci.alias("ci")).withColumn("z", newsvendor_z_of("cs", "ci"))
    ratio = F.least(F.greatest(F.col("cs") / (F.col("cs") + F.col("ci")), F.lit(0.001)), F.lit(0.999))
    return rows.select("p_partkey", ratio.alias("critical_ratio"), "z")


def _recommendation(where: str = "") -> str:
    return (
        T.chain(*_BEST, T.AHEAD, T.ABC, T.STOCK)
        + f""", last AS (SELECT product_id, arg_max(stock, month) AS stock FROM stock GROUP BY product_id),
    reco AS (SELECT abc.product_id, abc, winner, forecast, mae, {_ZPOL} AS z_policy, greatest(0, {_Z} * mae) AS ss, coalesce(stock, 0) AS stock,
      CAST(ceil(round(greatest(0, forecast + greatest(0, {_Z} * mae) - coalesce(stock, 0)), 9)) AS BIGINT) AS production, coalesce(stock, 0) < greatest(0, {_Z} * mae) AS at_risk, total AS total_demand
      FROM abc JOIN best ON best.product_id = abc.product_id JOIN ahead ON ahead.product_id = abc.product_id AND ahead.model = winner LEFT JOIN last ON last.product_id = abc.product_id {where})"""
    )


def _stock_low(spark, sf):
    return B.stock_monthly(tpch.balanced_ledger(spark, sf, opening=0.0))


def _recommend(spark, sf, **kw):
    d = C.demand(spark, sf)
    return choose.recommend(B.complete_series(d), d, _stock_low(spark, sf), **kw)


_RECO = _recommendation().replace(T.shared(T.LEDGER), T.shared(T.ledger(opening=0)))
_RD = each("forecast mae ss", 6)


@query("recommendations", _RECO + " SELECT * FROM reco", _RD)
def recommendations(spark, sf):
    return _recommend(spark, sf)


@query("recommendations_class_a_top", _recommendation("WHERE abc = 'A' QUALIFY row_number() OVER (ORDER BY total DESC, abc.product_id) <= 50").replace(T.shared(T.LEDGER), T.shared(T.ledger(opening=0))) + " SELECT * FROM reco", _RD)
def recommendations_class_a_top(spark, sf):
    return _recommend(spark, sf, abc_class="A", top=50)


@query("prioritized_products", _RECO + " SELECT * FROM reco ORDER BY at_risk DESC, production DESC, total_demand DESC, product_id LIMIT 10", _RD)
def prioritized_products(spark, sf):
    return P.prioritized(_recommend(spark, sf))


@query(
    "recommendation_kpis",
    _RECO + " SELECT count(*) AS n_products, count(*) FILTER (at_risk) AS n_at_risk, CAST(sum(production) AS BIGINT) AS total_production, CAST(floor(avg(production)) AS BIGINT) AS mean_production FROM reco",
)
def recommendation_kpis(spark, sf):
    return P.recommendation_kpis(_recommend(spark, sf))


_EVAL = "CASE WHEN n < 18 THEN least(12, greatest(1, n - 2)) ELSE 12 END"
_PICK = "CASE winner WHEN 'Seasonal12' THEN p_seasonal WHEN 'MA3' THEN p_ma3 WHEN 'MA6' THEN p_ma6 ELSE p_naive END"


def _replay_policy() -> str:
    return (
        T.chain(*_BEST, T.ABC, T.STOCK)
        + f""", changes AS (SELECT *, abs(demand - prev_demand) AS ch FROM cols),
    x AS (SELECT c.*, coalesce(avg(ch) OVER (PARTITION BY c.product_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS sigma, greatest(0, n - 1 - {_EVAL}) AS st FROM changes c),
    y AS (SELECT x.product_id, x.month, x.demand, x.pos, x.st, x.sigma, greatest(0, {_PICK}) AS forecast, {_ZPOL} * x.sigma AS ss,
      greatest(0, coalesce(max(CASE WHEN x.pos = x.st THEN s.stock END) OVER (PARTITION BY x.product_id), 0)) AS s0
      FROM x JOIN best ON best.product_id = x.product_id JOIN abc ON abc.product_id = x.product_id LEFT JOIN stock s ON s.product_id = x.product_id AND s.month = x.month),
    d AS (SELECT *, sum(demand) OVER (PARTITION BY product_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS cd FROM y WHERE pos > st),
    e AS (SELECT *, greatest(s0, max(greatest(forecast + ss - demand, 0) + cd) OVER (PARTITION BY product_id ORDER BY month ROWS UNBOUNDED PRECEDING)) - cd AS se FROM d),
    f AS (SELECT *, coalesce(lag(se) OVER (PARTITION BY product_id ORDER BY month), s0) AS ss0 FROM e),
    replay AS (SELECT product_id, month, ss0 AS stock_start, forecast, sigma, ss, greatest(0, forecast + ss - ss0) AS "order", demand, least(demand, ss0 + greatest(0, forecast + ss - ss0)) AS served,
      greatest(0, round(demand - ss0 - greatest(0, forecast + ss - ss0), 9)) AS lost, greatest(0, se) AS stock_end, round(demand - ss0 - greatest(0, forecast + ss - ss0), 9) > 0 AS stockout FROM f)"""
    ).replace(T.shared(T.LEDGER), T.shared(T.ledger(opening=0)))


def _replay(spark, sf):
    d = C.demand(spark, sf)
    s = B.complete_series(d)
    best = FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(s))))
    return P.replay_policy(s, _stock_low(spark, sf), best, A.abc(d))


@query("policy_replay", _replay_policy() + " SELECT * FROM replay", each("stock_start forecast sigma ss order served lost stock_end", 6))
def policy_replay(spark, sf):
    return _replay(spark, sf)


@query(
    "policy_replay_kpis",
    _replay_policy()
    + """ SELECT product_id, count(*) AS months, count(*) FILTER (stockout) AS stockout_months, CASE WHEN sum(demand) > 0 THEN 100 * sum(served) / sum(demand) ELSE 0 END AS fill_rate_pct,
    sum(lost) AS lost_units, avg(stock_end) AS mean_stock, sum("order") AS total_order FROM replay GROUP BY product_id""",
    each("fill_rate_pct lost_units mean_stock total_order", 6),
)
def policy_replay_kpis(spark, sf):
    return P.replay_kpis(_replay(spark, sf))


_COMPARE = (
    T.chain(*_BEST, T.ABC, T.STOCK)
    + f""", sg AS (SELECT b.product_id, b.winner, coalesce(max(CASE WHEN model = winner THEN s.mae END), min(s.mae)) AS sigma FROM best b JOIN scores s ON s.product_id = b.product_id GROUP BY b.product_id, b.winner),
    x AS (SELECT c.*, winner, sigma, greatest(0, {_PICK}) AS forecast, greatest(0, {_Z} * sigma) AS ss, greatest(1, n - 1 - {_EVAL}) AS st FROM cols c JOIN sg ON sg.product_id = c.product_id),
    y AS (SELECT x.*, greatest(0, coalesce(max(CASE WHEN x.pos = x.st - 1 THEN s.stock END) OVER (PARTITION BY x.product_id), 0)) AS s0
      FROM x LEFT JOIN stock s ON s.product_id = x.product_id AND s.month = x.month),
    d AS (SELECT *, sum(demand) OVER w AS cd, sum(greatest(0, prev_demand) - demand) OVER w AS cy FROM y WHERE pos >= st WINDOW w AS (PARTITION BY product_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, cy + greatest(s0, -min(cy) OVER w) AS be, greatest(s0, max(greatest(forecast + ss - demand, 0) + cd) OVER w) - cd AS se FROM d WINDOW w AS (PARTITION BY product_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, coalesce(lag(be) OVER w, s0) AS b0, coalesce(lag(se) OVER w, s0) AS a0 FROM e WINDOW w AS (PARTITION BY product_id ORDER BY month)),
    g AS (SELECT product_id, winner, sigma, month, demand, b0 AS base_stock_start, greatest(0, prev_demand) AS base_order, be AS base_stock_end, greatest(0, demand - b0 - greatest(0, prev_demand)) AS base_lost,
      forecast AS sys_forecast, ss AS sys_ss, a0 AS sys_stock_start, greatest(0, forecast + ss - a0) AS sys_order, greatest(0, se) AS sys_stock_end,
      CASE WHEN demand - a0 - greatest(0, forecast + ss - a0) < 1e-9 THEN 0 ELSE demand - a0 - greatest(0, forecast + ss - a0) END AS sys_lost FROM f),
    replay AS (SELECT *, base_stock_end * 1.0::DOUBLE AS base_cost_inventory, base_lost * 5.0::DOUBLE AS base_cost_stockout, base_stock_end + base_lost * 5.0::DOUBLE AS base_cost_total,
      sys_stock_end * 1.0::DOUBLE AS sys_cost_inventory, sys_lost * 5.0::DOUBLE AS sys_cost_stockout, sys_stock_end + sys_lost * 5.0::DOUBLE AS sys_cost_total FROM g)"""
).replace(T.shared(T.LEDGER), T.shared(T.ledger(opening=0)))

_SIDES = "stock_start order stock_end lost cost_inventory cost_stockout cost_total".split()
_SIDE_DIGITS = each(" ".join(f"{p}_{c}" for p in ("base", "sys") for c in _SIDES) + " sigma sys_forecast sys_ss", 6)


def _inputs(spark, sf):
    d = C.demand(spark, sf)
    s = B.complete_series(d)
    best = FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(s))))
    return d, s, best, _stock_low(spark, sf)


@query("replay_comparison", _COMPARE + " SELECT * FROM replay", _SIDE_DIGITS)
def replay_comparison(spark, sf):
    _, s, best, stock = _inputs(spark, sf)
    return P.replay_comparison(s, stock, best)


_KPIS = """, kpis AS (SELECT product_id, winner, count(*) AS months, min(month) AS first_month, max(month) AS last_month, sum(demand) AS demand, {sides} FROM replay {where} GROUP BY product_id, winner),
  full_kpis AS (SELECT *, base_cost_total - sys_cost_total AS savings, sys_fill_rate_pct - base_fill_rate_pct AS fill_rate_gain_pp, base_lost - sys_lost AS lost_reduction FROM kpis)"""


def _kpis(where: str = "") -> str:
    sides = ", ".join(
        f"count(*) FILTER ({p}_lost > 0) AS {p}_stockout_months, CASE WHEN sum(demand) > 0 THEN 100 * (sum(demand) - sum({p}_lost)) / sum(demand) ELSE 0 END AS {p}_fill_rate_pct, sum({p}_lost) AS {p}_lost, "
        f"sum({p}_cost_total) AS {p}_cost_total, sum({p}_cost_stockout) AS {p}_cost_stockout, sum({p}_cost_inventory) AS {p}_cost_inventory, avg({p}_stock_end) AS {p}_mean_stock"
        for p in ("base", "sys")
    )
    return _KPIS.replace("{sides}", sides).replace("{where}", where)


_KPI_DIGITS = each(" ".join(f"{p}_{c}" for p in ("base", "sys") for c in "fill_rate_pct lost cost_total cost_stockout cost_inventory mean_stock".split()) + " savings fill_rate_gain_pp lost_reduction", 5)
_ONLY_A = "WHERE product_id IN (SELECT product_id FROM abc WHERE abc = 'A')"


@query("comparison_kpis", _COMPARE + _kpis() + " SELECT * FROM full_kpis", _KPI_DIGITS)
def comparison_kpis(spark, sf):
    _, s, best, stock = _inputs(spark, sf)
    return P.comparison_kpis(P.replay_comparison(s, stock, best))


def _savings(spark, sf):
    d, s, best, stock = _inputs(spark, sf)
    return choose.portfolio_savings(s, stock, best, A.abc(d))


@query("class_a_savings", _COMPARE + _kpis(_ONLY_A) + " SELECT * FROM full_kpis", _KPI_DIGITS)
def class_a_savings(spark, sf):
    return _savings(spark, sf)


_TOTALS = "lost cost_total cost_inventory cost_stockout".split()


@query(
    "class_a_totals",
    _COMPARE
    + _kpis(_ONLY_A)
    + " SELECT count(*) AS n_products, sum(demand) AS demand, "
    + ", ".join(
        ", ".join(f"sum({p}_{c}) AS {p}_{c}" for c in _TOTALS) + f", (1 - sum({p}_lost) / sum(demand)) * 100 AS {p}_fill_rate_pct" for p in ("base", "sys")
    )
    + ", sum(savings) AS savings FROM full_kpis",
    each(" ".join(f"{p}_{c}" for p in ("base", "sys") for c in [*_TOTALS, "fill_rate_pct"]) + " savings", 4),
)
def class_a_totals(spark, sf):
    return P.portfolio_totals(_savings(spark, sf))


@query("top_savings", _COMPARE + _kpis(_ONLY_A) + " SELECT * FROM full_kpis ORDER BY round(savings, 6) DESC, product_id LIMIT 30", _KPI_DIGITS)
def top_savings(spark, sf):
    return P.top_savings(_savings(spark, sf))


_NAMES = "['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre']"


@query("demand_by_month_name", T.chain(T.LEDGER, T.DEMAND) + f" SELECT {_NAMES}[month(month)] AS month_name, sum(demand) AS demand FROM demand GROUP BY 1")
def demand_by_month_name(spark, sf):
    return C.demand(spark, sf).groupBy(month_name("month").alias("month_name")).agg(F.sum("demand").alias("demand"))


@query("recommendations_by_organization", T.by_org(_RECO + " SELECT * FROM reco", 0), _RD)
def recommendations_by_organization(spark, sf):
    d, s, stock = C.scoped_inputs(spark, sf, 0.0)
    return N.split_scope(choose.recommend(s, d, stock, classes=N.abc_by_organization(d)))


@query("replay_by_organization", T.by_org(_COMPARE + " SELECT * FROM replay", 0), _SIDE_DIGITS)
def replay_by_organization(spark, sf):
    _, s, stock = C.scoped_inputs(spark, sf, 0.0)
    best = FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(s))))
    return N.split_scope(P.replay_comparison(s, stock, best))


@query(
    "portfolio_by_organization",
    T.by_org(T.chain(*_BEST, T.ABC) + " SELECT b.product_id, winner, mae, rmse, n, abc, total FROM best b LEFT JOIN abc ON abc.product_id = b.product_id"),
    each("mae rmse", 6),
)
def portfolio_by_organization(spark, sf):
    d, s, _ = C.scoped_inputs(spark, sf)
    results = choose.ModelResults(FC.backtest_baselines(s), FC.next_month(s))
    per_product = choose.portfolio(s, d, results, classes=N.abc_by_organization(d))[0]
    return N.split_scope(per_product.select("product_id", "winner", "mae", "rmse", "n", "abc", "total"))
