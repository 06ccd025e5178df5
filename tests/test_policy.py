"""Closed-form replays against literal month-by-month loops."""

from __future__ import annotations

import math

import numpy as np
from helpers import month, series_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandry.functions.columns import newsvendor_z
from demandry.operators import forecast as FC
from demandry.operators import policy as P

MODELS = ["Naive", "Seasonal12", "MA3", "MA6"]
Z = {"A": 1.65, "B": 1.28, "C": 1.04}


def predict(model, past):
    if model == "Seasonal12":
        return past[-12] if len(past) >= 12 else past[-1]
    if model in ("MA3", "MA6"):
        return float(np.mean(past[-int(model[2]):]))
    return past[-1]


def window(n, months):
    return min(months, max(1, n - 2)) if n < months + 6 else months


def loop_policy(y, s0_by_month, model, abc):
    n = len(y)
    start = max(0, n - 1 - window(n, 12))
    stock = max(0.0, s0_by_month.get(start, 0.0))
    rows = []
    for t in range(start, n - 1):
        past = y[: t + 1]
        recent = past[-6:]
        sigma = float(np.mean(np.abs(np.diff(recent)))) if len(recent) >= 2 else 0.0
        f, ss = max(0.0, predict(model, past)), Z[abc] * sigma
        q = max(0.0, f + ss - stock)
        have, d = stock + q, y[t + 1]
        rows.append((t + 1, stock, f, sigma, ss, q, min(have, d), max(0.0, d - have), max(0.0, have - d)))
        stock = rows[-1][-1]
    return rows


def loop_comparison(y, s0_by_month, model, test=12):
    n = len(y)
    start = max(1, n - 1 - window(n, 12))
    targets = range(max(1, n - min(test, max(6, n - 2))), n)
    sigma = float(np.mean([abs(y[i] - predict(model, y[:i])) for i in targets]))
    ss = max(0.0, newsvendor_z(5.0, 1.0) * sigma)
    base = sys_ = max(0.0, s0_by_month.get(start - 1, 0.0))
    rows = []
    for t in range(start, n):
        d = y[t]
        have = base + max(0.0, y[t - 1])
        lost_b, end_b = max(0.0, d - have), max(0.0, have - d)
        f = max(0.0, predict(model, y[:t]))
        have = sys_ + max(0.0, f + ss - sys_)
        lost_s, end_s = max(0.0, d - have), max(0.0, have - d)
        rows.append((t, base, lost_b, end_b, sys_, f, ss, lost_s, end_s))
        base, sys_ = end_b, end_s
    return rows


def inputs(spark, data, stocks):
    s = series_frame(spark, {f"p{i:03d}": y for i, y in enumerate(data)})
    best = spark.createDataFrame([(f"p{i:03d}", MODELS[i % 4]) for i in range(len(data))], "product_id string, winner string")
    classes = spark.createDataFrame([(f"p{i:03d}", "ABC"[i % 3]) for i in range(len(data))], "product_id string, abc string")
    rows = [(f"p{i:03d}", month(k), v) for i, st_ in enumerate(stocks) for k, v in st_.items()]
    stock = spark.createDataFrame(rows or [("none", month(0), 0.0)], "product_id string, month date, stock double")
    return s, stock, best, classes


def close(a, b):
    return all(math.isclose(x, y, abs_tol=1e-7) for x, y in zip(a, b, strict=True))


def check(spark, data, stocks):
    s, stock, best, classes = inputs(spark, data, stocks)
    got: dict = {}
    for r in P.replay_policy(s, stock, best, classes).collect():
        got.setdefault(r.product_id, {})[r.month] = (r.stock_start, r.forecast, r.sigma, r.ss, r.order, r.served, r.lost, r.stock_end)
        assert math.isclose(r.served + r.lost, r.demand, abs_tol=1e-7)
        assert math.isclose(r.stock_start + r.order, r.served + r.stock_end, abs_tol=1e-7)
    cmp_: dict = {}
    for r in P.replay_comparison(s, stock, best).collect():
        cmp_.setdefault(r.product_id, {})[r.month] = (
            r.base_stock_start, r.base_lost, r.base_stock_end, r.sys_stock_start, r.sys_forecast, r.sys_ss, r.sys_lost, r.sys_stock_end,
        )
    for i, y in enumerate(data):
        p, model = f"p{i:03d}", MODELS[i % 4]
        want = loop_policy(y, stocks[i], model, "ABC"[i % 3])
        assert len(got.get(p, {})) == len(want)
        assert all(close(got[p][month(w[0])], w[1:]) for w in want)
        if len(y) >= 3:
            want = loop_comparison(y, stocks[i], model)
            assert len(cmp_[p]) == len(want)
            assert all(close(cmp_[p][month(w[0])], w[1:]) for w in want)


def test_random_series(spark):
    rng = np.random.default_rng(11)
    data, stocks = [], []
    for _ in range(200):
        n = int(rng.integers(3, 40))
        data.append([float(v) for v in rng.integers(0, 25, n)])
        stocks.append({k: float(rng.integers(-5, 60)) for k in range(n) if rng.random() < 0.7})
    check(spark, data, stocks)


@settings(max_examples=4, deadline=None)
@given(
    st.lists(
        st.lists(st.one_of(st.just(0.0), st.floats(0, 1000, allow_nan=False).map(lambda v: round(v, 3))), min_size=3, max_size=25),
        min_size=1, max_size=5,
    )
)
def test_any_series(spark, data):
    check(spark, data, [{0: 10.0, 5: 3.0} for _ in data])


def test_kpis_of_a_lost_month(spark):
    s, stock, best, classes = inputs(spark, [[5.0, 5.0, 5.0, 20.0]], [{}])
    k = P.comparison_kpis(P.replay_comparison(s, stock, best)).first()
    assert k.base_lost == 15.0 and k.base_stockout_months == 1 and k.base_cost_stockout == 75.0
    t = P.portfolio_totals(P.comparison_kpis(P.replay_comparison(s, stock, best))).first()
    assert math.isclose(t.base_fill_rate_pct, (1 - 15 / t.demand) * 100)


def test_fitted_models_can_drive_the_replay(spark):
    s, stock, _, _ = inputs(spark, [[5.0] * 20], [{}])
    best = spark.createDataFrame([("p000", FC.ETS)], "product_id string, winner string")
    preds = s.select("product_id", "month", F.lit(FC.ETS).alias("model"), F.col("demand").alias("y_true"), F.lit(7.0).alias("y_pred"))
    out = P.replay_comparison(s, stock, best, predictions=preds)
    assert {r.sys_forecast for r in out.collect()} == {7.0}
    assert {r.sigma for r in out.collect()} == {2.0}
