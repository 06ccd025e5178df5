"""Baselines, backtests, model choice and the fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.operators import analytics as A
from demandry.operators import build as B
from demandry.operators import ets as E
from demandry.operators import forecast as FC
from demandry.operators import forest as R
from demandry.plans import choose
from demandry.session import materialize
from demandry.sources import tpch
from suite import common as C
from suite import twin as T
from suite.registry import each, query

_TREES = {"trees": 20, "depth": 6}
_SERIES = (T.LEDGER, T.DEMAND, T.SERIES, T.COLUMNS)
_BEST = (*T.FORECAST, T.CHOSEN, T.ranked("chosen"), T.BEST)


@query(
    "baseline_columns",
    T.chain(*_SERIES) + ' SELECT product_id, month, demand, n, CAST(pos AS INTEGER) AS pos, p_naive AS "Naive", p_seasonal AS "Seasonal12", p_ma3 AS "MA3", p_ma6 AS "MA6" FROM cols',
    each("MA3 MA6", 9),
)
def baseline_columns(spark, sf):
    return FC.baseline_columns(C.series(spark, sf))


@query("backtest_baselines", T.chain(*T.FORECAST) + " SELECT * FROM preds", each("y_pred", 9))
def backtest_baselines(spark, sf):
    return FC.backtest_baselines(C.series(spark, sf))


_SCORES = each("mae rmse smape_pct mape_safe_pct", 6)


@query(
    "backtest_metrics",
    T.chain(*T.FORECAST)
    + """ SELECT product_id, model, mae, rmse, smape_pct, CASE WHEN mape_safe_pct < 1e6 THEN mape_safe_pct END AS mape_safe_pct,
    CASE WHEN mape_safe_pct >= 1e6 THEN mape_safe_pct / 1e9 END AS mape_safe_e9, n FROM scores""",
    each("mae rmse smape_pct mape_safe_pct mape_safe_e9", 6),
)
def backtest_metrics(spark, sf):
    # A month without demand puts 1e-9 under the error: such scores are shown in a column of their own, in units of 1e9.
    mape = F.col("mape_safe_pct")
    return C.scores(spark, sf).select(
        "product_id", "model", "mae", "rmse", "smape_pct", F.when(mape < 1e6, mape).alias("mape_safe_pct"), F.when(mape >= 1e6, mape / 1e9).alias("mape_safe_e9"), "n"
    )


@query(
    "backtest_auto_horizon",
    T.chain(*_SERIES, T.predictions("greatest(6, CAST(floor(n * 0.25) AS BIGINT))"), T.METRICS) + " SELECT product_id, model, mae, rmse, n FROM scores",
    each("mae rmse", 6),
)
def backtest_auto_horizon(spark, sf):
    return FC.metrics(FC.backtest_baselines(C.series(spark, sf), None)).select("product_id", "model", "mae", "rmse", "n")


@query(
    "auto_horizon",
    T.chain(*_SERIES) + " SELECT product_id, max(n) AS n, CAST(greatest(6, floor(max(n) * 0.25)) AS INTEGER) AS horizon FROM cols GROUP BY product_id",
)
def auto_horizon(spark, sf):
    return C.series(spark, sf).groupBy("product_id").agg(F.count("*").alias("n")).withColumn("horizon", FC.auto_horizon(F.col("n")))


@query(
    "model_comparison",
    T.chain(*T.FORECAST, T.ranked("scores")) + " SELECT product_id, model, mae, rmse, smape_pct, rank FROM ranked",
    each("mae rmse smape_pct", 6),
)
def model_comparison(spark, sf):
    return FC.compare(C.scores(spark, sf)).select("product_id", "model", "mae", "rmse", "smape_pct", "rank")


@query(
    "model_comparison_by_smape",
    T.chain(*T.FORECAST, T.ranked("scores", "smape_pct")) + " SELECT product_id, model, smape_pct, rank FROM ranked",
    each("smape_pct", 6),
)
def model_comparison_by_smape(spark, sf):
    return FC.compare(C.scores(spark, sf), "smape_pct").select("product_id", "model", "smape_pct", "rank")


@query(
    "winner_predictions",
    T.chain(*_BEST) + " SELECT p.product_id, model, month, y_true, y_pred FROM preds p JOIN best b ON p.product_id = b.product_id AND p.model = b.winner",
    each("y_pred", 9),
)
def winner_predictions(spark, sf):
    return FC.winner_predictions(FC.backtest_baselines(C.series(spark, sf)))


@query("ma_window_choice", T.chain(*T.FORECAST, T.CHOSEN) + " SELECT product_id, mae_set3, mae_set6, ma_window FROM windows", each("mae_set3 mae_set6", 6))
def ma_window_choice(spark, sf):
    return FC.ma_window(C.scores(spark, sf))


@query("next_month_baselines", T.chain(*_SERIES, T.AHEAD) + " SELECT * FROM ahead", each("forecast", 9))
def next_month_baselines(spark, sf):
    return FC.next_month(C.series(spark, sf))


@query(
    "next_month_with_winner",
    T.chain(*_BEST, T.AHEAD) + " SELECT a.product_id, a.month, winner, forecast FROM ahead a JOIN best b ON a.product_id = b.product_id AND a.model = b.winner",
    each("forecast", 9),
)
def next_month_with_winner(spark, sf):
    s = C.series(spark, sf)
    best = FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(s))))
    return FC.forecast_with_winner(FC.next_month(s), best)


@query(
    "quality_labels",
    T.chain(*_BEST)
    + """ SELECT product_id, winner, CASE WHEN round(smape_pct, 6) < 15 THEN 'excellent' WHEN round(smape_pct, 6) < 30 THEN 'good' ELSE 'review' END AS quality,
    CASE WHEN round(mae, 6) < 100 THEN 'excellent' WHEN round(mae, 6) < 300 THEN 'good' ELSE 'review' END AS error_level FROM best""",
)
def quality_labels(spark, sf):
    b = C.best(spark, sf).withColumns({"smape_pct": F.round("smape_pct", 6), "mae": F.round("mae", 6)})
    return b.select("product_id", "winner", FC.quality_label().alias("quality"), FC.error_label("mae").alias("error_level"))


@query(
    "portfolio_winners",
    T.chain(*_BEST, T.ABC) + " SELECT b.product_id, winner, mae, rmse, smape_pct, n, abc, total FROM best b LEFT JOIN abc ON abc.product_id = b.product_id",
    each("mae rmse smape_pct", 6),
)
def portfolio_winners(spark, sf):
    return _portfolio(spark, sf)[0].select("product_id", "winner", "mae", "rmse", "smape_pct", "n", "abc", "total")


def _portfolio(spark, sf):
    d = C.demand(spark, sf)
    s = B.complete_series(d)
    return choose.portfolio(s, d, choose.ModelResults(FC.backtest_baselines(s), FC.next_month(s)))


@query("wins_by_class", T.chain(*_BEST, T.ABC) + " SELECT abc, winner, count(*) AS n_products FROM best b LEFT JOIN abc ON abc.product_id = b.product_id GROUP BY abc, winner")
def wins_by_class(spark, sf):
    return _portfolio(spark, sf)[1]


@query(
    "errors_by_class",
    T.chain(*_BEST, T.ABC)
    + """ SELECT abc, count(*) AS n_products, avg(mae) AS mean_error, CASE WHEN sum(coalesce(total, 0)) <= 0 THEN avg(mae) ELSE sum(mae * coalesce(total, 0)) / sum(coalesce(total, 0)) END AS weighted_error
    FROM best b LEFT JOIN abc ON abc.product_id = b.product_id GROUP BY abc""",
    each("mean_error weighted_error", 6),
)
def errors_by_class(spark, sf):
    return _portfolio(spark, sf)[2]


@query(
    "last_predictions",
    T.chain(*_SERIES, T.predictions("20")) + " SELECT product_id, month, model, y_true, y_pred FROM preds QUALIFY row_number() OVER (PARTITION BY product_id, model ORDER BY month DESC) <= 12",
    each("y_pred", 9),
)
def last_predictions(spark, sf):
    return FC.last_predictions(FC.backtest_baselines(C.series(spark, sf), 20))


def _features() -> str:
    w = "OVER (PARTITION BY product_id ORDER BY month"
    cols = [f"lag(demand, {k}) {w}) AS lag_{k}" for k in (1, 2, 3, 6, 12)]
    for k in (3, 6, 12):
        f = f"{w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
        cols += [
            f"avg(demand) {f} AS roll_mean_{k}", f"coalesce(stddev_samp(demand) {f}, 0) AS roll_std_{k}",
            f"coalesce(sum(CASE WHEN demand > 0 THEN 1.0::DOUBLE ELSE 0 END) {f}, 0) AS roll_nonzero_{k}",
        ]
    for k in (6, 12):
        cols.append(f"coalesce(sum(CASE WHEN demand = 0 THEN 1.0::DOUBLE ELSE 0 END) {w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 0) AS zero_count_{k}")
    cal = "CAST(month(month) AS INTEGER) AS month_no, sin(2 * pi() * month(month) / 12) AS month_sin, cos(2 * pi() * month(month) / 12) AS month_cos"
    return f"SELECT product_id, month, demand, demand AS y, {', '.join(cols)}, {cal} FROM series"


_FLOATS = " ".join(f"roll_{s}_{k}" for s in ("mean", "std") for k in (3, 6, 12)) + " month_sin month_cos"


@query("lag_features", T.chain(T.LEDGER, T.DEMAND, T.SERIES) + " " + _features(), each(_FLOATS, 6))
def lag_features(spark, sf):
    return FC.features(C.series(spark, sf))


@query(
    "next_month_features",
    T.chain(T.LEDGER, T.DEMAND, T.SERIES)
    + f""", f AS ({_features()})
    SELECT * EXCLUDE (demand, y) REPLACE (CAST(month + INTERVAL 1 MONTH AS DATE) AS month, CAST(month(month + INTERVAL 1 MONTH) AS INTEGER) AS month_no,
      sin(2 * pi() * month(month + INTERVAL 1 MONTH) / 12) AS month_sin, cos(2 * pi() * month(month + INTERVAL 1 MONTH) / 12) AS month_cos)
    FROM f QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY month DESC) = 1""",
    each(_FLOATS, 6),
)
def next_month_features(spark, sf):
    return FC.next_month_features(C.series(spark, sf))


@query(
    "next_month_features_advanced",
    T.chain(T.LEDGER, T.DEMAND, T.SERIES.replace("series AS (", "known AS ("))
    + f""", series AS (SELECT * FROM known UNION ALL SELECT product_id, CAST(max(month) + INTERVAL 1 MONTH AS DATE), NULL FROM known GROUP BY product_id),
    f AS ({_features()}) SELECT * EXCLUDE (demand, y) FROM f WHERE demand IS NULL""",
    each(_FLOATS, 6),
)
def next_month_features_advanced(spark, sf):
    return FC.next_month_features(C.series(spark, sf), "advanced")


@query(
    "multi_period_baselines",
    T.chain(*_SERIES, T.AHEAD)
    + """, h AS (SELECT unnest(generate_series(1, 18)) AS step)
    SELECT e.product_id, CAST(e.month + to_months(CAST(step - 1 AS INTEGER)) AS DATE) AS month, CAST(step AS INTEGER) AS step, unnest(['Naive', 'Seasonal12', 'MA3', 'MA6']) AS model,
      unnest([f_naive, s.demand, f_ma3, f_ma6]) AS forecast FROM ends e CROSS JOIN h JOIN newest s ON s.product_id = e.product_id AND s.back = 12 - (step - 1) % 12""",
    each("forecast", 9),
)
def multi_period_baselines(spark, sf):
    return FC.multi_period(C.series(spark, sf), 18)


@query("multi_period_named_product")
def multi_period_named_product(spark, sf):
    products = tpch.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"))
    mine = B.product_demand(C.series(spark, sf), products, "red widget")
    return E.forecast_ets(mine, 6).unionByName(FC.multi_period(mine, 6))


@query(
    "multi_period_named_baselines",
    T.chain(*_SERIES, T.AHEAD)
    + """, h AS (SELECT unnest(generate_series(1, 6)) AS step)
    SELECT e.product_id, CAST(e.month + to_months(CAST(step - 1 AS INTEGER)) AS DATE) AS month, CAST(step AS INTEGER) AS step, unnest(['Naive', 'Seasonal12', 'MA3', 'MA6']) AS model,
      unnest([f_naive, s.demand, f_ma3, f_ma6]) AS forecast FROM ends e CROSS JOIN h JOIN newest s ON s.product_id = e.product_id AND s.back = 13 - step
    WHERE e.product_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE lower(p_name) LIKE '%red widget%')""",
    each("forecast", 9),
)
def multi_period_named_baselines(spark, sf):
    """The baseline half of ``multi_period_named_product``."""
    products = tpch.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"))
    return FC.multi_period(B.product_demand(C.series(spark, sf), products, "red widget"), 6)


# The forecasts of one model per product, named by the table ``best``, for twelve months.
_BY_WINNER = """, h AS (SELECT unnest(generate_series(1, 12)) AS step)
    SELECT e.product_id, CAST(e.month + to_months(CAST(step - 1 AS INTEGER)) AS DATE) AS month, CAST(step AS INTEGER) AS step, winner AS model,
      CASE winner WHEN 'Naive' THEN f_naive WHEN 'Seasonal12' THEN s.demand WHEN 'MA3' THEN f_ma3 WHEN 'MA6' THEN f_ma6 END AS forecast{more}
    FROM ends e CROSS JOIN h JOIN newest s ON s.product_id = e.product_id AND s.back = 13 - step JOIN {best} b ON b.product_id = e.product_id"""


@query("multi_period_best", T.chain(*_BEST, T.AHEAD) + _BY_WINNER.format(more="", best="best"), each("forecast", 9))
def multi_period_best(spark, sf):
    """Each product by the winner of its backtest among the baselines."""
    s = materialize(C.series(spark, sf), "series")
    best = FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(s))))
    return choose.multi_period(s, 12, best)


_MODELS = [*FC.BASELINES, FC.ETS, FC.FOREST]


@query(
    "multi_period_routed",
    T.chain(*_SERIES, T.AHEAD)
    + f""", given AS (SELECT product_id, list_extract({_MODELS}, CAST(product_id AS BIGINT) % {len(_MODELS)} + 1) AS winner FROM ends)"""
    + _BY_WINNER.format(more=f", winner IN ('{FC.ETS}', '{FC.FOREST}') AS fitted", best="given"),
    each("forecast", 9),
)
def multi_period_routed(spark, sf):
    """Each product by a model named for it, fitted ones among them; of those the value is left out, as SQL cannot fit them."""
    s = materialize(C.series(spark, sf), "series")
    at = F.col("product_id").cast("bigint") % len(_MODELS) + 1
    given = s.select("product_id").distinct().withColumn("winner", F.element_at(F.array(*map(F.lit, _MODELS)), at.cast("int")))
    out = choose.multi_period(s, 12, given, _TREES)
    # A fitted forecast is there, finite and not below 0, or its row does not say "fitted".
    fitted = F.col("model").isin(FC.ETS, FC.FOREST)
    sound = F.coalesce((F.col("forecast") >= 0) & (F.col("forecast") < float("inf")), F.lit(False))
    return out.withColumns({"fitted": fitted & sound, "forecast": F.when(~fitted, F.col("forecast"))})


@query("multi_period_best_fitted")
def multi_period_best_fitted(spark, sf):
    """Each product by the better of the two fitted models."""
    s = materialize(C.series(spark, sf), "series")
    best = materialize(choose.best_fitted(choose.all_models(s, 12, forest={**_TREES, "refit_every": 6})), "best")
    return choose.multi_period(s, 12, best, _TREES)


@query(
    "ets_given_weights",
    "WITH RECURSIVE " + T.chain(*_SERIES).removeprefix("WITH ")
    + """, h AS (
      SELECT product_id, list(demand ORDER BY month) AS y, list(month ORDER BY month) AS ms, count(*) AS n, 0.1 + CAST(product_id AS BIGINT) % 5 / 10.0::DOUBLE AS a
      FROM series GROUP BY product_id HAVING count(*) >= 24),
    states AS (
      SELECT h.*, 0 AS t, list_avg(y[1:12]) AS level, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS trend, list_transform(y[1:12], lambda x: x - list_avg(y[1:12])) AS season FROM h
      UNION ALL
      SELECT product_id, y, ms, n, a, t + 1, level + trend + a * e, trend + 0.05 * e, list_transform(season, lambda x, k: CASE WHEN k = t % 12 + 1 THEN x + 0.2 * e ELSE x END)
      FROM (SELECT *, y[t + 1] - (level + trend + season[t % 12 + 1]) AS e FROM states WHERE t < n))
    SELECT product_id, CAST(coalesce(ms[t + 1], ms[n] + INTERVAL 1 MONTH) AS DATE) AS month, y[t + 1] AS y_true, greatest(0, level + trend + season[t % 12 + 1]) AS y_pred FROM states""",
    each("y_pred", 6),
)
def ets_given_weights(spark, sf):
    """The state recursion of every product under weights that differ by product, checked month by month."""
    s = C.series(spark, sf).withColumn("alpha", 0.1 + (F.col("product_id").cast("bigint") % 5) / 10.0)
    return E.smooth(s, F.col("alpha"), 0.05, 0.2).drop("model")


@query("ets_backtest")
def ets_backtest(spark, sf):
    scored, _ = E.split_backtest(E.backtest_ets(C.series(spark, sf)))
    return FC.metrics(scored)


@query("ets_next_month")
def ets_next_month(spark, sf):
    return E.forecast_ets(C.series(spark, sf), 3)


@query("forest_backtest")
def forest_backtest(spark, sf):
    s = materialize(C.series(spark, sf), "series")
    return FC.metrics(R.backtest_forest(s, 12, refit_every=3, **_TREES))


@query("forest_next_month")
def forest_next_month(spark, sf):
    s = materialize(C.series(spark, sf), "series")
    return R.next_month_forest(s, **_TREES)


@query("forest_multi_period")
def forest_multi_period(spark, sf):
    s = materialize(C.series(spark, sf), "series")
    return R.multi_period_forest(s, 3, **_TREES)


@query("all_models_winners")
def all_models_winners(spark, sf):
    s = materialize(C.series(spark, sf), "series")
    results = choose.all_models(s, 12, forest={**_TREES, "refit_every": 6})
    return choose.select(results)
