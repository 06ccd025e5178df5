"""Holt-Winters (additive trend and season) for many series at once.

With the smoothing weights fixed, every one-step error is linear in the observations and in the starting
states. So for each weight triple the filter is one matrix, the best starting states are a least-squares
projection, and all series of an Arrow batch and all origins of a backtest are scored by matrix products.
The weights come from a grid, refined once around each series' best point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.operators.forecast import ETS

# The kernel travels with the query, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEASON = 12
MIN_OBS = 24
ALPHA = [0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]
BETA_SHARE = [0.0, 0.05, 0.2, 0.5]
GAMMA_SHARE = [0.0, 0.05, 0.15, 0.35, 0.7]


def _grid() -> list[tuple[float, float, float]]:
    return [(a, b, g) for a in ALPHA for b in BETA_SHARE for g in GAMMA_SHARE]


def _around(theta: tuple[float, float, float]) -> list[tuple[float, float, float]]:
    """Half a grid step to either side of each weight."""
    out = []
    for i, axis in enumerate((ALPHA, BETA_SHARE, GAMMA_SHARE)):
        k = axis.index(theta[i])
        for j in (k - 1, k + 1):
            if 0 <= j < len(axis):
                t = list(theta)
                t[i] = (axis[k] + axis[j]) / 2
                out.append(tuple(t))
    return out


def _weights(theta: tuple[float, float, float]) -> tuple[float, float, float]:
    a, b, g = theta
    return a, a * b, (1 - a) * g


def _filter(theta: tuple[float, float, float], n: int) -> tuple[np.ndarray, np.ndarray]:
    """M, D with errors = M y - D x0 for n steps; x0 = (level, trend, 11 seasonal terms, the 12th being 0)."""
    alpha, beta, gamma = _weights(theta)
    k = 1 + SEASON
    level, trend = np.zeros(n + k), np.zeros(n + k)
    season = [np.zeros(n + k) for _ in range(SEASON)]
    level[n], trend[n + 1] = 1.0, 1.0
    for j in range(SEASON - 1):
        season[j][n + 2 + j] = 1.0
    e = np.empty((n, n + k))
    for t in range(n):
        s = season[t % SEASON]
        err = -(level + trend + s)
        err[t] += 1.0
        e[t] = err
        level, trend = level + trend + alpha * err, trend + beta * err
        season[t % SEASON] = s + gamma * err
    return e[:, :n], -e[:, n:]


def _solve(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of D's columns and the map from errors to starting states."""
    u, s, vt = np.linalg.svd(d, full_matrices=False)
    ok = s > s[0] * 1e-10
    return u[:, ok], vt[ok].T / s[ok]


class _Scorer:
    """Squared errors and next values for a batch of equally long series at several origins."""

    def __init__(self, y: np.ndarray, origins: list[int]):
        self.y, self.origins = y, origins
        self.padded = np.hstack([y, np.zeros((len(y), 1))])

    def score(self, theta: tuple[float, float, float], rows: np.ndarray | slice, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n = self.y.shape[1]
        m, d = _filter(theta, n + 1)
        err = self.padded[rows] @ m.T
        power = np.cumsum(err * err, axis=1)
        sse, nxt = [], []
        for i in which:
            o = self.origins[i]
            u, back = _solve(d[:o])
            proj = err[:, :o] @ u
            sse.append(power[:, o - 1] - (proj * proj).sum(axis=1))
            start = proj @ back.T
            # Forecast of month o from the months before it: the observation minus its error.
            nxt.append(self.padded[rows][:, o] - err[:, o] + start @ d[o])
        return np.array(sse), np.array(nxt)


def _forecast_batch(y: np.ndarray, origins: list[int], refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts (series x origins) and the index-coded best weights of the last origin."""
    sc = _Scorer(y, origins)
    every = list(range(len(origins)))
    grid = _grid()
    best = np.full((len(origins), len(y)), np.inf)
    out = np.zeros((len(origins), len(y)))
    arg = np.zeros((len(origins), len(y)), dtype=int)
    for g, theta in enumerate(grid):
        sse, nxt = sc.score(theta, slice(None), every)
        # Weights are tried in grid order; a later triple must be better by more than rounding.
        better = sse < best - 1e-9 * (1.0 + np.abs(np.where(np.isfinite(best), best, 0.0)))
        best, out, arg = np.where(better, sse, best), np.where(better, nxt, out), np.where(better, g, arg)
    chosen = np.array([[*grid[g]] for g in arg[-1]])
    if refine:
        centre = arg.copy()
        for g in np.unique(centre):
            hit = centre == g
            which = [i for i in every if hit[i].any()]
            rows = np.flatnonzero(hit.any(axis=0))
            for theta in _around(grid[g]):
                sse, nxt = sc.score(theta, rows, which)
                for r, i in enumerate(which):
                    old = best[i, rows]
                    better = hit[i, rows] & (sse[r] < old - 1e-9 * (1.0 + np.abs(old)))
                    best[i, rows[better]] = sse[r][better]
                    out[i, rows[better]] = nxt[r][better]
                    if i == len(origins) - 1:
                        chosen[rows[better]] = theta
    return out.T, chosen


def _extend(y: np.ndarray, theta: tuple[float, float, float], periods: int) -> np.ndarray:
    """Forecasts of ``periods`` months after the end of one group of series that share their weights."""
    n = y.shape[1]
    m, d = _filter(theta, n)
    err = y @ m.T
    u, back = _solve(d)
    x0 = (err @ u) @ back.T
    alpha, beta, gamma = _weights(theta)
    level, trend = x0[:, 0].copy(), x0[:, 1].copy()
    season = np.hstack([x0[:, 2:], np.zeros((len(y), 1))])
    for t in range(n):
        s = season[:, t % SEASON].copy()
        e = y[:, t] - (level + trend + s)
        level, trend = level + trend + alpha * e, trend + beta * e
        season[:, t % SEASON] = s + gamma * e
    return np.stack([level + h * trend + season[:, (n + h - 1) % SEASON] for h in range(1, periods + 1)], axis=1)


def _one_step(series: list[np.ndarray], test_months: int, refine: bool) -> list[list[float]]:
    """Forecasts at the last ``test_months`` origins and for the month after the end, with the fallbacks."""
    out: list[list[float]] = [[] for _ in series]
    lengths = np.array([len(s) for s in series])
    for n in np.unique(lengths):
        idx = np.flatnonzero(lengths == n)
        if n == 0:
            for i in idx:
                out[i] = [0.0]
            continue
        y = np.stack([series[i] for i in idx])
        targets = [*range(max(1, n - test_months), n), n] if test_months else [n]
        res = np.stack([y[:, t - 1] for t in targets], axis=1)  # last value: the fallback
        long_enough = [t for t in targets if t >= MIN_OBS]
        if long_enough:
            fit, _ = _forecast_batch(y, long_enough, refine)
            for j, t in enumerate(long_enough):
                flat = np.all(np.isclose(y[:, :t], 0.0), axis=1)
                v = np.where(np.isfinite(fit[:, j]), np.maximum(fit[:, j], 0.0), y[:, t - 1])
                res[:, targets.index(t)] = np.where(flat, 0.0, v)
        for r, i in enumerate(idx):
            out[i] = res[r].tolist()
    return out


def _multi_step(series: list[np.ndarray], periods: int, refine: bool) -> list[list[float]]:
    out: list[list[float]] = [[] for _ in series]
    lengths = np.array([len(s) for s in series])
    for n in np.unique(lengths):
        idx = np.flatnonzero(lengths == n)
        if n == 0:
            for i in idx:
                out[i] = [0.0] * periods
            continue
        y = np.stack([series[i] for i in idx])
        res = np.repeat(y[:, -1:], periods, axis=1)
        if n >= MIN_OBS:
            _, theta = _forecast_batch(y, [n], refine)
            for t in np.unique(theta, axis=0):
                rows = np.flatnonzero((theta == t).all(axis=1))
                v = _extend(y[rows], tuple(t), periods)
                res[rows] = np.where(np.isfinite(v), np.maximum(v, 0.0), res[rows])
            res[np.all(np.isclose(y, 0.0), axis=1)] = 0.0
        for r, i in enumerate(idx):
            out[i] = res[r].tolist()
    return out


def _histories(series: DataFrame) -> DataFrame:
    """One row per product: its months and demand as arrays (as long as there are months)."""
    return series.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("month", "demand"))).alias("h")).select(
        "product_id", F.col("h.month").alias("months"), F.col("h.demand").alias("y")
    )


def backtest_ets(series: DataFrame, test_months: int = 12, refine: bool = True) -> DataFrame:
    """Long predictions refitted at every origin, plus the month after the last with y_true null."""

    @F.pandas_udf("array<double>")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(_one_step([np.asarray(v, dtype=float) for v in b], test_months, refine))

    hist = _histories(series).withColumn("p", fit("y"))
    n, k = F.size("y"), F.size("p")
    # p[j] is the forecast for month n - (k - 1) + j; the last one lies beyond the history.
    return (
        hist.select("product_id", "months", "y", (n - k + 1).alias("first"), F.posexplode("p").alias("j", "y_pred"))
        .withColumn("at", F.col("first") + F.col("j"))
        .select(
            "product_id",
            F.coalesce(F.get("months", F.col("at")), F.add_months(F.element_at("months", -1), 1)).alias("month"),
            F.lit(ETS).alias("model"),
            F.get("y", F.col("at")).alias("y_true"),
            "y_pred",
        )
    )


def split_backtest(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored months and next-month forecasts of :func:`backtest_ets`."""
    scored = predictions.where(F.col("y_true").isNotNull())
    ahead = predictions.where(F.col("y_true").isNull()).select("product_id", "month", "model", F.col("y_pred").alias("forecast"))
    return scored, ahead


def forecast_ets(series: DataFrame, periods: int = 1, refine: bool = True) -> DataFrame:
    """Forecasts for the next 1..``periods`` months."""

    @F.pandas_udf("array<double>")
    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(_multi_step([np.asarray(v, dtype=float) for v in b], periods, refine))

    return (
        _histories(series).select("product_id", F.element_at("months", -1).alias("last"), F.posexplode(fit("y")).alias("j", "forecast"))
        .select("product_id", F.expr("add_months(last, j + 1)").alias("month"), (F.col("j") + 1).alias("step"), F.lit(ETS).alias("model"), "forecast")
    )


def smooth(series: DataFrame, alpha: float | Column, beta: float | Column, gamma: float | Column) -> DataFrame:
    """One-step forecasts of every month and of the one after the last, for given weights and textbook starting states.

    The level starts as the mean of the first season, the trend as a twelfth of the second season's gain over it, the
    seasonal terms as the first season's differences from the level. Series of less than two seasons have no
    rows. ``y_true`` is null for the month after the last. The recursion runs inside one row per product, without Python; weights
    may be columns of ``series`` that are constant for a product.
    """
    weights = [w if isinstance(w, Column) else F.lit(float(w)) for w in (alpha, beta, gamma)]
    named = [w.cast("double").alias(n) for w, n in zip(weights, ("a", "b", "g"))]
    held = series.select("product_id", "month", "demand", *named).groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("month", "demand"))).alias("h"), *[F.first(n).alias(n) for n in ("a", "b", "g")]
    )
    held = held.where(F.size("h") >= MIN_OBS).select("product_id", F.col("h.month").alias("months"), F.col("h.demand").alias("y"), "a", "b", "g")
    mean = lambda first: F.aggregate(F.slice("y", first, SEASON), F.lit(0.0), lambda s, x: s + x) / SEASON
    held = held.withColumn("l0", mean(1)).withColumn("t0", (mean(SEASON + 1) - F.col("l0")) / SEASON)
    start = F.struct(
        F.col("l0").alias("level"), F.col("t0").alias("trend"), F.transform(F.slice("y", 1, SEASON), lambda x: x - F.col("l0")).alias("season"),
        F.array().cast("array<double>").alias("ahead"),
    )
    guess = lambda s, t: s["level"] + s["trend"] + F.get(s["season"], t % SEASON)

    def step(s: Column, t: Column) -> Column:
        miss = F.get(F.col("y"), t) - guess(s, t)
        return F.struct(
            (s["level"] + s["trend"] + F.col("a") * miss).alias("level"), (s["trend"] + F.col("b") * miss).alias("trend"),
            F.transform(s["season"], lambda x, k: F.when(k == t % SEASON, x + F.col("g") * miss).otherwise(x)).alias("season"),
            F.array_append(s["ahead"], guess(s, t)).alias("ahead"),
        )

    n = F.size("y")
    ahead = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: F.array_append(s["ahead"], guess(s, n)))
    return held.select("product_id", "months", "y", F.posexplode(ahead).alias("at", "ahead")).select(
        "product_id",
        F.coalesce(F.get("months", F.col("at")), F.add_months(F.element_at("months", -1), 1)).alias("month"),
        F.lit(ETS).alias("model"),
        F.get("y", F.col("at")).alias("y_true"),
        F.greatest(F.lit(0.0), F.col("ahead")).alias("y_pred"),
    )
