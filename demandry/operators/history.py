"""One row per product with its months, demand, stock and fitted predictions in arrays.

What looks at a whole history (forecasts of every month, errors, spread, the stock at some month) is then worked out inside the
row. Series, stock and predictions meet in one exchange by product, and each is read once. A row holds as many
entries as there are months and models, however many movements the product had.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.operators import forecast as FC

_MONTH = "struct<month: date, demand: double>"
_STOCK = "struct<month: date, stock: double>"
_FITTED = "struct<model: string, month: date, y_true: double, y_pred: double>"


def pack(series: DataFrame, stock: DataFrame | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """product_id, n, months (month and demand, in order), demand, stock and fitted; only products with a series.

    ``predictions`` are kept for models that are not baselines, as those follow from the series.
    """
    row = lambda **given: [
        given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in (("month", _MONTH), ("stock", _STOCK), ("fitted", _FITTED))
    ]
    parts = [series.select("product_id", *row(month=F.struct("month", F.col("demand").cast("double"))))]
    if stock is not None:
        parts.append(stock.select("product_id", *row(stock=F.struct("month", F.col("stock").cast("double")))))
    if predictions is not None:
        own = predictions.where(~F.col("model").isin(*FC.BASELINES))
        parts.append(own.select("product_id", *row(fitted=F.struct("model", "month", "y_true", "y_pred"))))
    held = reduce(DataFrame.unionAll, parts).groupBy("product_id").agg(
        F.sort_array(F.collect_list("month")).alias("months"), F.collect_list("stock").alias("stock"), F.collect_list("fitted").alias("fitted")
    )
    return held.where(F.size("months") > 0).select("product_id", F.size("months").alias("n"), "months", F.col("months.demand").alias("demand"), "stock", "fitted")


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _before(i: Column, window: int, values: Column) -> Column:
    """The mean of the ``window`` entries before place i, or of as many as there are; null at the first."""
    return _mean(F.slice(values, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))))


def baseline(model: str, i: Column, demand: Column) -> Column:
    """The forecast of a baseline for place i of a demand array."""
    last = F.get(demand, i - 1)
    if model == FC.SEASONAL:
        return F.coalesce(F.get(demand, i - FC.SEASON), last)
    return last if model == FC.NAIVE else _before(i, {FC.MA3: 3, FC.MA6: 6}[model], demand)


def forecast_at(i: Column) -> Column:
    """The forecast for place i by the row's winner: a fitted prediction where there is one, else a baseline, else the last demand."""
    demand, month = F.col("demand"), F.get(F.col("months"), i)["month"]
    out = baseline(FC.NAIVE, i, demand)
    for m in (FC.SEASONAL, FC.MA3, FC.MA6):
        out = F.when(F.col("winner") == m, baseline(m, i, demand)).otherwise(out)
    fitted = F.filter("fitted", lambda e: (e["model"] == F.col("winner")) & (e["month"] == month))
    return F.greatest(F.lit(0.0), F.coalesce(F.get(fitted, F.lit(0))["y_pred"], out))


def recent_change(i: Column, months: int = 6) -> Column:
    """The mean absolute change among the ``months`` entries before place i; 0 where there is none."""
    first = F.greatest(i - (months - 1), F.lit(1))
    places = F.when(i - 1 >= first, F.sequence(first, i - 1)).otherwise(F.array().cast("array<int>"))
    change = F.transform(places, lambda k: F.abs(F.get(F.col("demand"), k) - F.get(F.col("demand"), k - 1)))
    return F.coalesce(_mean(change), F.lit(0.0))


def stock_at(i: Column) -> Column:
    """The stock of the month at place i, 0 if there is none or it is negative."""
    month = F.get(F.col("months"), i)["month"]
    return F.greatest(F.lit(0.0), F.coalesce(F.get(F.filter("stock", lambda s: s["month"] == month), F.lit(0))["stock"], F.lit(0.0)))


def winner_error(test_months: int) -> Column:
    """MAE of the row's winner over the last min(test, max(6, n - 2)) months; the least MAE of a model if it has none; null without any."""
    n, demand = F.col("n"), F.col("demand")
    first = F.greatest(F.lit(1), n - F.least(F.lit(test_months), F.greatest(F.lit(6), n - 2)))
    places = F.when(n >= 3, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>"))
    error = lambda m: _mean(F.transform(places, lambda i: F.abs(F.get(demand, i) - baseline(m, i, demand))))
    errors = {m: error(m) for m in FC.BASELINES}
    of = lambda model: _mean(F.transform(F.filter("fitted", lambda e: e["model"] == model), lambda e: F.abs(e["y_true"] - e["y_pred"])))
    own = of(F.col("winner"))
    for m in FC.BASELINES:
        own = F.when(F.col("winner") == m, errors[m]).otherwise(own)
    fitted = F.array_min(F.transform(F.array_distinct("fitted.model"), of))
    return F.greatest(F.lit(0.0), F.coalesce(own, F.least(*errors.values(), fitted)))


def each_month(packed: DataFrame, start: Column, columns: dict[str, Column | object], keep: list[str]) -> DataFrame:
    """A row for each month from place ``start`` on: what is kept of the product, month, demand, and ``columns`` as functions of the place."""
    one = lambda i: F.struct(
        F.get(F.col("months"), i)["month"].alias("month"), F.get(F.col("demand"), i).alias("demand"), *[f(i).alias(c) for c, f in columns.items()]
    )
    places = F.when(start < F.col("n"), F.sequence(start, F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return packed.select(*keep, F.inline(F.transform(places, one)))
