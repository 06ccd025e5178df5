"""Random forest over the lag features, one pooled model per origin.

Demand and the features in its units are divided by the product's own level, so one model serves
products of any size; the number of fits is the number of origins, whatever the number of products.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.operators import forecast as FC
from demandry.session import materialize

MIN_OBS = 24
_IN_UNITS = [c for c in FC.FEATURES if c.startswith(("lag_", "roll_mean", "roll_std"))]


def _level() -> Column:
    """A product's level before the month: its rolling mean over a year, at least one unit."""
    return F.greatest(F.coalesce(F.col("roll_mean_12"), F.lit(0.0)), F.lit(1.0))


def _prepared(feats: DataFrame) -> DataFrame:
    """Missing features as 0, unit features and target relative to the level, features in a vector."""
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FC.FEATURES}
    out = feats.withColumn("level", _level()).withColumns(zero)
    out = out.withColumns({c: F.col(c) / F.col("level") for c in _IN_UNITS})
    if "y" in out.columns:
        out = out.withColumn("label", F.col("y") / F.col("level"))
    return VectorAssembler(inputCols=FC.FEATURES, outputCol="features").transform(out)


def _training(series: DataFrame) -> DataFrame:
    """Features and label of every month, written once: a fit goes over them several times and keeps each partition in one piece,
    so their size is that of a file split and does not grow with the table."""
    return materialize(_prepared(FC.features(series)).select("features", "label"), "training")


def _fit(train: DataFrame, trees: int, depth: int, seed: int) -> RandomForestRegressionModel:
    model = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=1, featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed
    )
    return model.fit(train.select("features", "label"))


def _predicted(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("raw", F.col("prediction") * F.col("level"))


def _usable(raw: Column, fallback: Column, enough: Column) -> Column:
    """The forest's value, not below 0; the seasonal forecast for short histories or unusable values."""
    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) < float("inf"))
    return F.when(enough & finite, F.greatest(F.lit(0.0), raw)).otherwise(fallback)


def backtest_forest(
    series: DataFrame, test_months: int = 12, *, trees: int = 400, depth: int = 12, seed: int = 42, refit_every: int = 1,
    mode: str = "reference",
) -> DataFrame:
    """Long predictions (product, month, model, y_true, y_pred), refitted before every ``refit_every``-th month.

    The months of the backtest are counted back from the last month of the table.
    ``mode`` is the feature row used to predict, as in :func:`demandry.operators.forecast.next_month_features`.
    """
    if mode not in ("reference", "advanced"):
        raise ValueError(f"unknown mode {mode}")
    # Positions, features and those of the month before are windows over one order: one shuffle, and no join that could send a
    # table of all products and months, which is small only as long as it lies compressed, through the driver.
    placed = FC.features(FC.baseline_columns(series.where(F.col("product_id").isNotNull() & F.col("month").isNotNull())))
    facts = ["product_id", "month", "n", "pos", FC.SEASONAL]
    if mode == "advanced":
        held = _prepared(placed).select(*facts, F.col("y").alias("y_true"), "label", "features", F.col("features").alias("ask"), F.col("level").alias("ask_level"))
    else:
        # The row used for month t is that of month t-1 with the calendar of t.
        calendar = ["month_no", "month_sin", "month_cos"]
        before = F.lag(F.struct(*[c for c in FC.FEATURES if c not in calendar])).over(Window.partitionBy("product_id").orderBy("month"))
        own = _prepared(placed.withColumn("before", before))
        asked = own.select(*facts, F.col("y").alias("y_true"), "label", F.col("features").alias("own"), *calendar, "before.*")
        held = _prepared(asked).select(*facts, "y_true", "label", F.col("own").alias("features"), F.col("features").alias("ask"), F.col("level").alias("ask_level"))
    # Read by every fit; written once, so that a fit sees the same rows again after a lost executor.
    held = materialize(held, "training")
    # At most test_months dates.
    last = [r.month for r in held.select("month").distinct().orderBy(F.desc("month")).limit(test_months).collect()][::-1]
    fits: list[tuple[RandomForestRegressionModel, list]] = []
    for i, m in enumerate(last):
        if not fits or i % refit_every == 0:
            train = held.where(F.col("month") < F.lit(m))
            if train.isEmpty():
                continue
            fits.append((_fit(train, trees, depth, seed), []))
        fits[-1][1].append(m)
    out = None
    # The months of one fit are read together.
    for model, months in fits:
        rows = held.where(F.col("month").isin(months) & (F.col("n") >= 3) & (F.col("pos") >= 1))
        rows = rows.select("product_id", "month", "pos", FC.SEASONAL, "y_true", F.col("ask").alias("features"), F.col("ask_level").alias("level"))
        one = _predicted(model, rows).select(
            "product_id", "month", F.lit(FC.FOREST).alias("model"), "y_true",
            _usable(F.col("raw"), F.col(FC.SEASONAL), F.col("pos") >= MIN_OBS).alias("y_pred"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no month has a history to train on")
    return out


def next_month_forest(series: DataFrame, *, trees: int = 400, depth: int = 12, seed: int = 42, mode: str = "reference") -> DataFrame:
    """Forecast of the month after the last (product, month, model, forecast)."""
    model = _fit(_training(series), trees, depth, seed)
    ask = _prepared(FC.next_month_features(series, mode))
    seasonal = FC.next_month(series).where(F.col("model") == FC.SEASONAL).select("product_id", F.col("forecast").alias("__fallback"))
    size = series.groupBy("product_id").agg(F.count("*").alias("__n"))
    # One row a product on each side, all partitioned by it: sorted and merged, not sent through the driver.
    rows = _predicted(model, ask).join(seasonal.hint("merge"), "product_id").join(size.hint("merge"), "product_id")
    return rows.select(
        "product_id", "month", F.lit(FC.FOREST).alias("model"),
        _usable(F.col("raw"), F.col("__fallback"), F.col("__n") >= MIN_OBS).alias("forecast"),
    )


def multi_period_forest(
    series: DataFrame, periods: int, *, trees: int = 400, depth: int = 12, seed: int = 42, asked: DataFrame | None = None
) -> DataFrame:
    """Forecasts for the next 1..``periods`` months: each step's forecast joins the history of the next.

    The model learns from all of ``series``; with ``asked``, forecasts are made for those rows' products alone.
    Every step is written to the shared folder, so the plan of a step does not contain those before it.
    """
    if not 1 <= periods <= 24:
        raise ValueError("periods must be between 1 and 24")
    model = _fit(_training(series), trees, depth, seed)
    whole = Window.partitionBy("product_id")
    asked = series if asked is None else asked
    sized = asked.select("product_id", "month", "demand", F.count("*").over(whole).alias("size"), F.max("month").over(whole).alias("last"))
    # One row a product with its newest year, newest first: a step needs no shuffle, and rows do not get more from step to step.
    recent = sized.where(F.col("product_id").isNotNull() & (F.col("month") > F.add_months("last", -13)))
    rows = recent.groupBy("product_id").agg(
        F.max("month").alias("month"), F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("month", "demand")), asc=False).alias("h")
    )
    known = materialize(rows.withColumn("h", F.slice(F.col("h.demand").cast("array<double>"), 1, FC.SEASON)), "history")
    out = None
    for step in range(1, periods + 1):
        ask = FC.with_calendar(known.withColumn("month", F.add_months("month", 1)).withColumns(FC.features_after(F.col("h"))))
        fallback = F.coalesce(F.get("h", F.lit(FC.SEASON - 1)), F.col("h")[0])
        one = _predicted(model, _prepared(ask)).withColumn("demand", _usable(F.col("raw"), fallback, F.col("size") >= MIN_OBS))
        known = materialize(one.select("product_id", "month", "size", F.slice(F.concat(F.array("demand"), "h"), 1, FC.SEASON).alias("h")), "step")
        labelled = known.select("product_id", "month", F.lit(step).alias("step"), F.lit(FC.FOREST).alias("model"), F.col("h")[0].alias("forecast"))
        out = labelled if out is None else out.unionByName(labelled)
    return out
