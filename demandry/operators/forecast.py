"""Baseline forecasts, rolling-origin backtests, model choice. Every product in one plan.

A series has one row per product and month with gaps filled, so a product's history is at most as many
rows as there are months and fits one window, however hot the product was in the ledger.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import ratio

NAIVE, SEASONAL, ETS, FOREST = "Naive", "Seasonal12", "ETS(Holt-Winters)", "RandomForest"
MA3, MA6 = "MA3", "MA6"
# Ties go to the earlier family, then to the earlier name, as when tables are appended in this order.
FAMILY = {NAIVE: 0, SEASONAL: 0, MA3: 0, MA6: 0, ETS: 1, FOREST: 2}
SEASON = 12
EPS = 1e-9
BASELINES = [NAIVE, SEASONAL, MA3, MA6]
METRICS = ["mae", "rmse", "smape_pct", "mape_safe_pct"]


def _w() -> Window:
    return Window.partitionBy("product_id").orderBy("month")


def moving_average(window: int, y: str = "demand") -> Column:
    return F.avg(y).over(_w().rowsBetween(-window, -1))


def baseline_columns(series: DataFrame) -> DataFrame:
    """Each month with its position and the forecasts made for it from the months before."""
    ordered = series.withColumns({"pos": F.row_number().over(_w()) - 1, **_baselines()})
    # After the ordered windows, so that one sort by product and month serves all of them.
    return ordered.withColumn("n", F.count("*").over(Window.partitionBy("product_id")))


def _baselines() -> dict[str, Column]:
    w = _w()
    return {
        NAIVE: F.lag("demand", 1).over(w),
        SEASONAL: F.coalesce(F.lag("demand", SEASON).over(w), F.lag("demand", 1).over(w)),
        MA3: moving_average(3),
        MA6: moving_average(6),
    }


def auto_horizon(n: Column) -> Column:
    """A quarter of the history, at least six months."""
    return F.greatest(F.lit(6), F.floor(n * 0.25)).cast("int")


def _targets(columns: DataFrame, test_months: int | None) -> DataFrame:
    """The months scored: the last ``test_months`` (or the automatic horizon), never the first; none below three."""
    return columns.where((F.col("n") >= 3) & (F.col("pos") >= F.greatest(F.lit(1), F.col("n") - _horizon(test_months))))


def _horizon(test_months: int | None) -> Column:
    return auto_horizon(F.col("n")) if test_months is None else F.lit(int(test_months))


def backtest_wide(series: DataFrame, test_months: int | None = 12) -> DataFrame:
    """One row per product and scored month, one column per baseline.

    Forecasts look back a season at most, so they are worked out for the scored months and the season before them, not for the
    whole history."""
    placed = series.withColumn("pos", F.row_number().over(_w()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("product_id")))
    recent = placed.where(F.col("pos") >= F.col("n") - _horizon(test_months) - SEASON)
    return _targets(recent.withColumns(_baselines()), test_months).select(
        "product_id", "month", F.col("demand").alias("y_true"), *BASELINES
    )


def to_long(wide: DataFrame, models: list[str]) -> DataFrame:
    """Predictions by model as rows. A generator, so the partitioning by product survives."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_pred")) for m in models])
    return wide.select("product_id", "month", "y_true", F.inline(rows)).select("product_id", "month", "model", "y_true", "y_pred")


def backtest_baselines(series: DataFrame, test_months: int | None = 12, models: list[str] = BASELINES) -> DataFrame:
    """Long predictions (product, month, model, y_true, y_pred) of the baselines."""
    return to_long(backtest_wide(series, test_months), models)


def metrics(predictions: DataFrame, keys: list[str] = ["product_id", "model"]) -> DataFrame:  # noqa: B006
    """MAE, RMSE, sMAPE %, safe MAPE % and count per product and model."""
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    scale = F.greatest(F.abs("y_true") + F.abs("y_pred"), F.lit(EPS))
    return predictions.groupBy(*keys).agg(
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(2 * e / scale) * 100).alias("smape_pct"),
        (F.avg(e / F.greatest(F.abs("y_true"), F.lit(EPS))) * 100).alias("mape_safe_pct"),
        F.count("*").alias("n"),
    )


def _family(model: Column) -> Column:
    out = F.lit(max(FAMILY.values()) + 1)
    for m, f in FAMILY.items():
        out = F.when(model == m, F.lit(f)).otherwise(out)
    return out


def _place(model: Column) -> Column:
    out = F.lit(len(FAMILY))
    for i, m in enumerate([NAIVE, SEASONAL, MA3, MA6, ETS, FOREST]):
        out = F.when(model == m, F.lit(i)).otherwise(out)
    return out


def compare(scores: DataFrame, by: str = "mae") -> DataFrame:
    """Models of each product ranked by a metric (unknown names fall back to MAE).

    Scores are compared to 9 digits so that equal errors are ties; ties go to the smaller family, MAE and then
    the fixed model order.
    """
    metric = by if by in METRICS else "mae"
    w = Window.partitionBy("product_id").orderBy(
        F.round(metric, 9).asc_nulls_last(), _family(F.col("model")), F.round("mae", 9).asc_nulls_last(), _place(F.col("model"))
    )
    return scores.withColumn("rank", F.row_number().over(w))


def winners(scores: DataFrame, by: str = "mae") -> DataFrame:
    """The best model of each product with its scores."""
    return compare(scores, by).where(F.col("rank") == 1).drop("rank").withColumnRenamed("model", "winner")


def winner_predictions(predictions: DataFrame, by: str = "mae") -> DataFrame:
    """The scored predictions of each product's best model, chosen as by ``winners(with_chosen_window(metrics(...)))``.

    Scores, the choice of the moving average and the winner are windows over the predictions of a product: one
    shuffle, no join."""
    metric = by if by in METRICS else "mae"
    product, model = Window.partitionBy("product_id"), Window.partitionBy("product_id", "model")
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    scale = F.greatest(F.abs("y_true") + F.abs("y_pred"), F.lit(EPS))
    score = {
        "mae": F.avg(e).over(model),
        "rmse": F.sqrt(F.avg(e * e).over(model)),
        "smape_pct": F.avg(2 * e / scale).over(model) * 100,
        "mape_safe_pct": F.avg(e / F.greatest(F.abs("y_true"), F.lit(EPS))).over(model) * 100,
    }
    scored = predictions.withColumns({"mae": score["mae"], "__by": F.round(score[metric], 9)}).withColumns(_set_errors(predictions, product))
    loser = F.when(_window_choice() == 3, MA6).otherwise(MA3)
    order = F.struct(F.col("__by").isNull().alias("x"), F.col("__by"), _family(F.col("model")).alias("f"), F.round("mae", 9).alias("m"), _place(F.col("model")).alias("p"))
    ranked = scored.where(F.col("model") != loser).withColumn("__order", order).withColumn("__best", F.min("__order").over(product))
    return ranked.where(F.col("__order") == F.col("__best")).select(*predictions.columns)


def _set_errors(scores: DataFrame, over: Window | None) -> dict[str, Column]:
    best = lambda drop: F.min(F.when(F.col("model").isin(NAIVE, SEASONAL, drop), F.round("mae", 9)))
    cols = {"mae_set3": best(MA3), "mae_set6": best(MA6)}
    return {k: c.over(over) for k, c in cols.items()} if over is not None else cols


def _window_choice() -> Column:
    return F.when(F.col("mae_set3") < F.col("mae_set6"), 3).otherwise(6)


def ma_window(scores: DataFrame) -> DataFrame:
    """3 or 6 per product: the set whose best baseline has the lower MAE; 6 on a tie."""
    sets = _set_errors(scores, None)
    out = scores.where(F.col("model").isin(*BASELINES)).groupBy("product_id").agg(*[c.alias(k) for k, c in sets.items()])
    return out.withColumn("ma_window", _window_choice())


def with_chosen_window(scores: DataFrame) -> DataFrame:
    """Scores without the moving average that lost the window choice. A handful of rows per product, one pass."""
    out = scores.withColumns(_set_errors(scores, Window.partitionBy("product_id")))
    loser = F.when(_window_choice() == 3, MA6).otherwise(MA3)
    return out.where(F.col("model") != loser).drop("mae_set3", "mae_set6")


def next_month(series: DataFrame) -> DataFrame:
    """Baseline forecasts for the month after the last, long form (product, month, model, forecast)."""
    hist = series.groupBy("product_id").agg(
        F.max("month").alias("last_month"),
        F.transform(F.sort_array(F.collect_list(F.struct("month", "demand")), asc=False), lambda s: s["demand"]).alias("y"),
    )
    mean = lambda k: F.aggregate(F.slice("y", 1, k), F.lit(0.0), lambda a, v: a + v) / F.least(F.size("y"), F.lit(k))
    forecasts = {
        NAIVE: F.col("y")[0],
        SEASONAL: F.coalesce(F.get("y", F.lit(SEASON - 1)), F.col("y")[0]),
        MA3: mean(3),
        MA6: mean(6),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.greatest(e, F.lit(0.0)).alias("forecast")) for m, e in forecasts.items()])
    return hist.select("product_id", F.add_months("last_month", 1).alias("month"), F.inline(rows))


def forecast_with_winner(forecasts: DataFrame, best: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Next-month forecast of the winning model; a product whose winner is unknown gets the naive one.

    ``keep`` names columns of ``best`` to carry along.
    """
    per_product = forecasts.groupBy("product_id").agg(
        F.max("month").alias("month"), F.map_from_entries(F.collect_list(F.struct("model", "forecast"))).alias("by_model")
    )
    pick = F.coalesce(F.try_element_at("by_model", F.col("winner")), F.try_element_at("by_model", F.lit(NAIVE)))
    carried = keep or []
    return per_product.join(best.select("product_id", "winner", *carried), "product_id").select(
        "product_id", "month", "winner", F.greatest(pick, F.lit(0.0)).alias("forecast"), *carried
    )


def quality_label(smape: str = "smape_pct") -> Column:
    return F.when(F.col(smape) < 15, "excellent").when(F.col(smape) < 30, "good").otherwise("review")


def error_label(mae: str) -> Column:
    return F.when(F.col(mae) < 100, "excellent").when(F.col(mae) < 300, "good").otherwise("review")


def wins_by_class(best: DataFrame, classes: DataFrame) -> DataFrame:
    return best.join(classes.select("product_id", "abc"), "product_id", "left").groupBy("abc", "winner").agg(F.count("*").alias("n_products"))


def errors_by_class(best: DataFrame, classes: DataFrame, metric: str = "mae") -> DataFrame:
    """Mean error of the winners per class, plain and weighted by total demand."""
    joined = best.join(classes.select("product_id", "abc", "total"), "product_id", "left")
    weight = F.coalesce(F.col("total"), F.lit(0.0))
    plain, den = F.avg(metric), F.sum(weight)
    return joined.groupBy("abc").agg(
        F.count("*").alias("n_products"),
        plain.alias("mean_error"),
        F.when(den <= 0, plain).otherwise(F.try_divide(F.sum(F.col(metric) * weight), den)).alias("weighted_error"),
    )


def last_predictions(predictions: DataFrame, n: int = 12) -> DataFrame:
    """The newest ``n`` predictions of each product and model."""
    w = Window.partitionBy("product_id", "model").orderBy(F.desc("month"))
    return predictions.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def features(series: DataFrame) -> DataFrame:
    """Lags, rolling statistics and calendar of each month, all from the months before it."""
    w = _w()
    before = lambda k: w.rowsBetween(-k, -1)
    count_of = lambda cond, k: F.coalesce(F.sum(F.when(cond, 1.0).otherwise(0.0)).over(before(k)), F.lit(0.0))
    cols: dict[str, Column] = {f"lag_{k}": F.lag("demand", k).over(w) for k in (1, 2, 3, 6, 12)}
    for k in (3, 6, 12):
        cols[f"roll_mean_{k}"] = F.avg("demand").over(before(k))
        cols[f"roll_std_{k}"] = F.coalesce(F.stddev_samp("demand").over(before(k)), F.lit(0.0))
        cols[f"roll_nonzero_{k}"] = count_of(F.col("demand") > 0, k)
    for k in (6, 12):
        cols[f"zero_count_{k}"] = count_of(F.col("demand") == 0, k)
    return with_calendar(series.withColumn("y", F.col("demand")).withColumns(cols))


def with_calendar(df: DataFrame) -> DataFrame:
    m = F.month("month")
    return df.withColumns(
        {"month_no": m, "month_sin": F.sin(m * (2 * math.pi / 12.0)), "month_cos": F.cos(m * (2 * math.pi / 12.0))}
    )


FEATURES = [
    "lag_1", "lag_2", "lag_3", "lag_6", "lag_12",
    *[f"roll_{s}_{k}" for k in (3, 6, 12) for s in ("mean", "std", "nonzero")],
    "zero_count_6", "zero_count_12", "month_no", "month_sin", "month_cos",
]


def next_month_features(series: DataFrame, mode: str = "reference") -> DataFrame:
    """One feature row per product for the month after its last.

    ``reference``: the last month's lags and rolling values with the next month's calendar.
    ``advanced``: lags and rolling values moved on by one month as well.
    """
    if mode == "reference":
        feats = features(series).drop("month_no", "month_sin", "month_cos")
        rest = [c for c in feats.columns if c not in ("product_id", "month", "y", "demand")]
        last = feats.groupBy("product_id").agg(F.max_by(F.struct("month", *rest), "month").alias("r")).select("product_id", "r.*")
        return with_calendar(last.withColumn("month", F.add_months("month", 1)))
    if mode != "advanced":
        raise ValueError(f"unknown mode {mode}")
    w = Window.partitionBy("product_id")
    stretched = series.withColumn("__last", F.max("month").over(w)).withColumn(
        "__new", F.explode(F.when(F.col("month") == F.col("__last"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    plus = stretched.select(
        "product_id",
        F.when(F.col("__new"), F.add_months("month", 1)).otherwise(F.col("month")).alias("month"),
        F.when(~F.col("__new"), F.col("demand")).alias("demand"),
        "__new",
    )
    return features(plus).where(F.col("__new")).drop("__new", "demand", "y")


def features_after(h: Column) -> dict[str, Column]:
    """The lags and rolling statistics of :func:`features` for the month after a history, from its demand as an array, newest first."""
    cols: dict[str, Column] = {f"lag_{k}": F.get(h, F.lit(k - 1)) for k in (1, 2, 3, 6, 12)}
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("avg"), F.lit(0.0).alias("m2"))

    def add(a: Column, v: Column) -> Column:
        n, d = a["n"] + 1.0, v - a["avg"]
        return F.struct(n.alias("n"), (a["avg"] + d / n).alias("avg"), (a["m2"] + d * (d - d / n)).alias("m2"))

    for k in (3, 6, 12):
        # In the order of the months, as a window adds them up.
        last = F.filter(F.reverse(F.slice(h, 1, k)), lambda v: v.isNotNull())
        n = F.size(last)
        cols[f"roll_mean_{k}"] = F.when(n > 0, F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / n)
        cols[f"roll_std_{k}"] = F.when(n > 1, F.aggregate(last, zero, add, lambda a: F.sqrt(a["m2"] / (a["n"] - 1.0)))).otherwise(0.0)
        cols[f"roll_nonzero_{k}"] = F.size(F.filter(last, lambda v: v > 0)).cast("double")
        if k > 3:
            cols[f"zero_count_{k}"] = F.size(F.filter(last, lambda v: v == 0)).cast("double")
    return cols


def multi_period(series: DataFrame, periods: int) -> DataFrame:
    """Baseline forecasts for the next 1..``periods`` months: flat, except the seasonal one, which repeats its year."""
    if not 1 <= periods <= 24:
        raise ValueError("periods must be between 1 and 24")
    hist = series.groupBy("product_id").agg(
        F.max("month").alias("last_month"),
        F.transform(F.sort_array(F.collect_list(F.struct("month", "demand")), asc=False), lambda s: s["demand"]).alias("y"),
    )
    mean = lambda k: F.aggregate(F.slice("y", 1, k), F.lit(0.0), lambda a, v: a + v) / F.least(F.size("y"), F.lit(k))
    h = F.col("step")
    seasonal = F.when(F.size("y") < SEASON, F.col("y")[0]).otherwise(F.get("y", (SEASON - 1) - (h - 1) % SEASON))
    steps = hist.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.greatest(e, F.lit(0.0)).alias("forecast"))
            for m, e in {NAIVE: F.col("y")[0], SEASONAL: seasonal, MA3: mean(3), MA6: mean(6)}.items()
        ]
    )
    return steps.select("product_id", F.add_months("last_month", h).alias("month"), "step", F.inline(rows))
