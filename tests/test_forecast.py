from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import month, series_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandry.functions.columns import newsvendor_z, newsvendor_z_of, normal_quantile
from demandry.operators import analytics as A
from demandry.operators import build as B
from demandry.operators import ets as E
from demandry.operators import forecast as FC
from demandry.operators import forest as R
from demandry.plans import choose

# Demand per product over twelve months, and the stock at the end of the last.
SAMPLE = {
    "PROD001": [150, 165, 180, 175, 190, 200, 185, 195, 210, 220, 230, 250],
    "PROD002": [300, 320, 310, 330, 340, 360, 350, 370, 390, 410, 430, 450],
    "PROD003": [75, 80, 85, 82, 88, 92, 89, 94, 100, 105, 110, 115],
}
LAST_STOCK = {"PROD001": 5.0, "PROD002": 30.0, "PROD003": 5.0}
# Expected MAE, RMSE, sMAPE %, MAPE % and next month.
EXPECTED = {
    ("PROD001", "Naive"): (13.333333, 13.844373, 6.315286, 6.212075, 250.0),
    ("PROD001", "Seasonal12"): (13.333333, 13.844373, 6.315286, 6.212075, 150.0),
    ("PROD001", "MA3"): (16.388889, 19.208891, 7.604367, 7.245677, 233.333333),
    ("PROD001", "MA6"): (24.027778, 26.664496, 11.469415, 10.750976, 215.0),
    ("PROD002", "Naive"): (18.333333, 18.708287, 4.657162, 4.560735, 450.0),
    ("PROD002", "MA3"): (29.444444, 32.001157, 7.465578, 7.158298, 430.0),
    ("PROD002", "MA6"): (47.222222, 49.356976, 12.339135, 11.583000, 400.0),
    ("PROD003", "Naive"): (4.833333, 4.915960, 4.823104, 4.724187, 115.0),
    ("PROD003", "MA3"): (7.555556, 8.282065, 7.492478, 7.177374, 110.0),
    ("PROD003", "MA6"): (11.861111, 12.530888, 12.088779, 11.349004, 102.166667),
}


def test_sample_file(spark):
    s = series_frame(spark, SAMPLE)
    ahead = {(r.product_id, r.model): r.forecast for r in FC.next_month(s).collect()}
    scores = FC.metrics(FC.backtest_baselines(s, None))
    got = {(r.product_id, r.model): r for r in scores.collect()}
    for key, (mae, rmse, smape, mape, nxt) in EXPECTED.items():
        r = got[key]
        for a, b in ((r.mae, mae), (r.rmse, rmse), (r.smape_pct, smape), (r.mape_safe_pct, mape), (ahead[key], nxt)):
            assert math.isclose(a, b, abs_tol=1e-6)
        assert r.n == 6
    assert {(r.product_id, r.winner) for r in FC.winners(FC.with_chosen_window(scores)).collect()} == {(p, "Naive") for p in SAMPLE}
    assert {r.ma_window for r in FC.ma_window(scores).collect()} == {6}
    classes = {r.product_id: (round(r.share, 6), round(r.cum_share, 6), r.abc) for r in A.abc(s).collect()}
    assert classes == {"PROD002": (0.557188, 0.557188, "A"), "PROD001": (0.300319, 0.857508, "B"), "PROD003": (0.142492, 1.0, "C")}
    stock = spark.createDataFrame([(p, month(11), v) for p, v in LAST_STOCK.items()], "product_id string, month date, stock double")
    results = choose.ModelResults(FC.backtest_baselines(s, None), FC.next_month(s))
    reco = {r.product_id: r for r in choose.recommend(s, s, stock, results).collect()}
    assert math.isclose(reco["PROD001"].ss, 12.898954, abs_tol=1e-6)
    assert (reco["PROD001"].production, reco["PROD001"].at_risk) == (258, True)


def test_backtest_is_a_rolling_origin(spark):
    rng = np.random.default_rng(3)
    data = {f"p{k}": [float(v) for v in rng.integers(0, 30, n)] for k, n in enumerate([2, 3, 5, 14, 40])}
    got = {(r.product_id, r.month, r.model): r.y_pred for r in FC.backtest_baselines(series_frame(spark, data), 12).collect()}
    want = {}
    for p, y in data.items():
        n = len(y)
        if n < 3:
            continue
        for i in range(max(1, n - 12), n):
            past = y[:i]
            want[p, month(i), "Naive"] = past[-1]
            want[p, month(i), "Seasonal12"] = past[-12] if len(past) >= 12 else past[-1]
            for w in (3, 6):
                want[p, month(i), f"MA{w}"] = float(np.mean(past[-w:]))
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_metrics(spark):
    rows = [("p", "m", 10.0, 8.0), ("p", "m", 0.0, 2.0), ("q", "m", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "product_id string, model string, y_true double, y_pred double")
    got = {r.product_id: r for r in FC.metrics(df).collect()}
    p = got["p"]
    assert (p.mae, p.n) == (2.0, 2) and math.isclose(p.rmse, 2.0)
    assert math.isclose(p.smape_pct, 100 * (2 * 2 / 18 + 2 * 2 / 2) / 2)
    assert math.isclose(p.mape_safe_pct, 100 * (0.2 + 2 / 1e-9) / 2)
    assert got["q"].smape_pct == 0.0


def test_ties(spark):
    # Short history: the seasonal forecast equals the naive one, and the naive one is listed first.
    s = series_frame(spark, {"a": [5, 7, 9, 11, 13, 15, 17, 19]})
    scores = FC.metrics(FC.backtest_baselines(s, 6))
    assert FC.winners(scores).first().winner == "Naive"
    # Both sets have the same best baseline, so the window is 6.
    assert FC.ma_window(scores).first().ma_window == 6
    assert {r.model for r in FC.with_chosen_window(scores).collect()} == {"Naive", "Seasonal12", "MA6"}


def test_unknown_metric_means_mae(spark):
    s = series_frame(spark, {"a": [5, 9, 2, 11, 3, 15, 7, 19]})
    scores = FC.metrics(FC.backtest_baselines(s, 6))
    rank = lambda by: [(r.model, r["rank"]) for r in FC.compare(scores, by).orderBy("rank").collect()]
    assert rank("nonsense") == rank("mae")


def test_next_month_and_horizons(spark):
    y = [float(v) for v in range(1, 31)]
    s = series_frame(spark, {"long": y, "short": [4.0, 6.0]})
    got = {(r.product_id, r.model): (r.forecast, r.month) for r in FC.next_month(s).collect()}
    assert got["long", "Naive"] == (30.0, month(30))
    assert got["long", "Seasonal12"][0] == 19.0 and got["long", "MA3"][0] == 29.0
    assert got["short", "Seasonal12"][0] == 6.0 and got["short", "MA6"][0] == 5.0
    steps = {(r.model, r.step): r.forecast for r in FC.multi_period(s.where("product_id = 'long'"), 14).collect()}
    assert [steps["Seasonal12", h] for h in (1, 12, 13)] == [19.0, 30.0, 19.0]
    assert len({steps["MA3", h] for h in range(1, 15)}) == 1
    with pytest.raises(ValueError):
        FC.multi_period(s, 25)


def test_unknown_winner_falls_back_to_naive(spark):
    s = series_frame(spark, {"a": [1.0, 2.0, 9.0]})
    best = spark.createDataFrame([("a", "Oracle")], "product_id string, winner string")
    assert FC.forecast_with_winner(FC.next_month(s), best).first().forecast == 9.0


def test_complete_series_and_short_products(spark):
    rows = [("a", month(0), 3.0), ("a", month(4), 5.0), ("b", month(2), 1.0)]
    d = spark.createDataFrame(rows, "product_id string, month date, demand double")
    out = B.complete_series(d)
    assert out.count() == 2 * 5 and out.agg(F.sum("demand")).first()[0] == 9.0
    inside = {(r.product_id, r.month): r.demand for r in B.complete_series(d, start=str(month(1)), end=str(month(3))).collect()}
    assert inside == {(p, month(i)): (1.0 if (p, i) == ("b", 2) else 0.0) for p in "ab" for i in (1, 2, 3)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=20), min_size=1, max_size=6))
def test_properties(spark, data):
    s = series_frame(spark, {f"p{i}": y for i, y in enumerate(data)})
    for r in FC.metrics(FC.backtest_baselines(s)).collect():
        assert r.mae >= 0 and r.rmse + 1e-9 >= r.mae and 0 <= r.smape_pct <= 200 + 1e-9
    classes = A.abc(s.withColumnRenamed("month", "m")).orderBy("cum_share").collect()
    total = sum(map(sum, data))
    assert math.isclose(sum(r.share for r in classes), 1.0 if total else 0.0, abs_tol=1e-9)
    if total:
        assert math.isclose(max(r.cum_share for r in classes), 1.0)
    else:
        assert {r.abc for r in classes} == {"C"}


def test_single_dominant_product_is_class_c(spark):
    d = spark.createDataFrame([("a", 100.0)], "product_id string, demand double")
    assert A.abc(d).first().abc == "C"


def test_ets_follows_trend_and_season_exactly(spark):
    season = [10 * math.sin(2 * math.pi * k / 12) for k in range(12)]
    y = [100 + 2 * t + season[t % 12] for t in range(48)]
    s = series_frame(spark, {"x": y})
    scored, ahead = E.split_backtest(E.backtest_ets(s, 12))
    assert max(abs(r.y_true - r.y_pred) for r in scored.collect()) < 1e-6
    assert math.isclose(ahead.first().forecast, 100 + 2 * 48 + season[0], abs_tol=1e-6)
    h = {r.step: r.forecast for r in E.forecast_ets(s, 15).collect()}
    assert all(math.isclose(h[k], 100 + 2 * (47 + k) + season[(47 + k) % 12], abs_tol=1e-6) for k in h)


def test_ets_fallbacks(spark):
    s = series_frame(spark, {"short": [float(k) for k in range(23)], "zero": [0.0] * 30, "down": [max(0.0, 60.0 - 3 * k) for k in range(30)]})
    last = {r.product_id: r.forecast for r in E.split_backtest(E.backtest_ets(s))[1].collect()}
    assert last["short"] == 22.0 and last["zero"] == 0.0 and last["down"] >= 0.0
    months = {r.product_id: r.n for r in E.backtest_ets(s).groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    assert set(months.values()) == {13}


def test_ets_error_is_no_larger_than_a_plain_grid(spark):
    rng = np.random.default_rng(1)
    y = np.stack([rng.poisson(20, 60).astype(float) for _ in range(5)])
    coarse, _ = E._forecast_batch(y, [60], refine=False)
    fine, _ = E._forecast_batch(y, [60], refine=True)
    assert coarse.shape == fine.shape == (5, 1) and np.isfinite(fine).all()


def test_ets_matches_the_recursion():
    """The matrix form gives the errors of the textbook recursion for the same weights and starting states."""
    rng = np.random.default_rng(2)
    y, theta = rng.poisson(15, 40).astype(float), (0.35, 0.2, 0.15)
    m, d = E._filter(theta, 40)
    x0 = rng.normal(size=13)
    a, b, g = E._weights(theta)
    level, trend, season = x0[0], x0[1], [*x0[2:], 0.0]
    errors = []
    for t in range(40):
        e = y[t] - (level + trend + season[t % 12])
        level, trend = level + trend + a * e, trend + b * e
        season[t % 12] += g * e
        errors.append(e)
    assert np.allclose(m @ y - d @ x0, errors)


def test_forest(spark):
    rng = np.random.default_rng(5)
    data = {f"p{k}": [float(v) for v in rng.poisson(10 + k, 36)] for k in range(4)} | {"short": [3.0, 4.0, 5.0, 6.0]}
    s = series_frame(spark, data)
    one = {r.product_id: r.forecast for r in R.next_month_forest(s, trees=5, depth=4).collect()}
    two = {r.product_id: r.forecast for r in R.next_month_forest(s, trees=5, depth=4).collect()}
    assert one == two and min(one.values()) >= 0.0 and one["short"] == 6.0
    back = R.backtest_forest(s.where("product_id != 'short'"), 2, trees=5, depth=4).collect()
    assert len(back) == 8 and all(r.y_pred >= 0 for r in back)


def test_newsvendor(spark):
    assert math.isclose(newsvendor_z(5, 1), 0.9674215661, abs_tol=1e-9)
    assert math.isclose(newsvendor_z(10, 1), 1.3351777361, abs_tol=1e-9)
    assert newsvendor_z(0, 0) == 1.65
    pairs = [(5.0, 1.0), (10.0, 1.0), (0.0, 0.0), (1.0, 1e6), (1e6, 1.0), (1.0, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", newsvendor_z_of("a", "b").alias("z"))
    assert all(math.isclose(r.z, newsvendor_z(r.a, r.b), rel_tol=1e-7, abs_tol=1e-7) for r in df.collect())
    q = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p")).select("p", normal_quantile(F.col("p")).alias("z")).collect()
    from statistics import NormalDist

    assert max(abs(r.z - NormalDist().inv_cdf(r.p)) for r in q) < 1e-8


def test_recommendation_of_a_steady_product(spark):
    y = [10.0] * 24
    s = series_frame(spark, {"a": y})
    stock = s.select("product_id", "month", F.lit(4.0).alias("stock"))
    r = choose.recommend(s, s, stock).first()
    assert (r.winner, r.forecast, r.ss, r.stock, r.production, r.at_risk) == ("Naive", 10.0, 0.0, 4.0, 6, False)


def test_each_product_by_its_winner(spark):
    """Routed forecasts are those of the winner's own operator; the forest learns from products it does not forecast."""
    rng = np.random.default_rng(3)
    names = {"n": FC.NAIVE, "s": FC.SEASONAL, "m": FC.MA6, "e": FC.ETS, "f": FC.FOREST, "unknown": "Oracle"}
    s = series_frame(spark, {p: list(rng.integers(0, 50, 30).astype(float)) for p in [*names, "absent"]})
    best = spark.createDataFrame([*names.items(), ("n", FC.NAIVE), ("elsewhere", FC.NAIVE)], "product_id string, winner string")
    few = {"trees": 3, "depth": 3}
    rows = {(r.product_id, r.step): r for r in choose.multi_period(s, 4, best, few).collect()}
    assert len(rows) == 7 * 4 and {p for p, _ in rows} == {*names, "absent"}
    plain = {(r.product_id, r.model, r.step): r for r in FC.multi_period(s, 4).unionByName(E.forecast_ets(s, 4)).unionByName(R.multi_period_forest(s, 4, **few)).collect()}
    for (p, step), r in rows.items():
        model = names.get(p, FC.NAIVE)
        model = FC.NAIVE if model == "Oracle" else model
        want = plain[p, model, step]
        assert r.model == model and r.month == want.month
        if model == FC.FOREST:
            assert math.isfinite(r.forecast) and r.forecast >= 0
        else:
            assert r.forecast == pytest.approx(want.forecast)
    # Without settings for a forest its products get the naive forecast.
    bare = choose.multi_period(s, 2, best).where("product_id = 'f'").collect()
    assert {r.model for r in bare} == {FC.NAIVE}
    with pytest.raises(ValueError):
        choose.multi_period(s, 25, best)


def test_routing_handles_tables_without_rows(spark):
    s = series_frame(spark, {"a": [1.0, 2.0, 3.0]})
    none = spark.createDataFrame([], "product_id string, winner string")
    assert {r.model for r in choose.multi_period(s, 2, none, {"trees": 1, "depth": 1}).collect()} == {FC.NAIVE}
    assert choose.multi_period(s.limit(0), 2, none, {"trees": 1, "depth": 1}).count() == 0


def test_best_fitted_compares_only_fitted_models(spark):
    rows = [("a", FC.NAIVE, 0.0), ("a", FC.ETS, 2.0), ("a", FC.FOREST, 1.0), ("b", FC.ETS, 1.0), ("c", FC.NAIVE, 0.0)]
    preds = spark.createDataFrame([(p, month(0), m, 10.0, 10.0 + e) for p, m, e in rows], "product_id string, month date, model string, y_true double, y_pred double")
    got = {r.product_id: r.winner for r in choose.best_fitted(choose.ModelResults(preds, preds)).collect()}
    assert got == {"a": FC.FOREST, "b": FC.ETS}


@pytest.mark.parametrize("horizon", [None, 3, 12, 30])
def test_backtests_look_at_the_scored_months_and_a_season_before(spark, horizon):
    """The same as over the whole history, from the rows that a forecast can look at."""
    rng = np.random.default_rng(5)
    s = series_frame(spark, {f"p{n}": [float(v) for v in rng.poisson(5, n)] for n in (1, 2, 3, 7, 13, 24, 25, 60)})
    whole = FC._targets(FC.baseline_columns(s), horizon).select("product_id", "month", F.col("demand").alias("y_true"), *FC.BASELINES)
    out = FC.backtest_wide(s, horizon)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    text = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # The scored months, the months looked at, and the bound on the length: the lags stand above a filter by place.
    lags = text[text.index("lag(") :]
    assert any("Filter" in x and "pos" in x for x in lags.splitlines())
