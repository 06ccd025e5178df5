"""Backtests of all models, the best per product, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.functions.columns import newsvendor_z
from demandry.operators import analytics as A
from demandry.operators import ets as E
from demandry.operators import forecast as FC
from demandry.operators import forest as R
from demandry.operators import policy as P
from demandry.session import materialize


@dataclass
class ModelResults:
    predictions: DataFrame  # scored months, long
    ahead: DataFrame  # next month, long


def all_models(series: DataFrame, test_months: int = 12, *, ets: bool = True, forest: dict | None = None) -> ModelResults:
    """Scored predictions and next-month forecasts of the baselines and, on request, the fitted models.

    Fitted results are written to the shared folder: they are costly and used several times.
    """
    predictions, ahead = FC.backtest_baselines(series, test_months), FC.next_month(series)
    if ets:
        fitted = materialize(E.backtest_ets(series, test_months), "ets")
        scored, nxt = E.split_backtest(fitted)
        keep = series.groupBy("product_id").agg(F.count("*").alias("n")).where("n >= 3").select("product_id")
        predictions = predictions.unionByName(scored.join(keep, "product_id", "left_semi"))
        ahead = ahead.unionByName(nxt)
    if forest is not None:
        predictions = predictions.unionByName(materialize(R.backtest_forest(series, test_months, **forest), "forest"))
        single = {k: v for k, v in forest.items() if k != "refit_every"}
        ahead = ahead.unionByName(R.next_month_forest(series, **single))
    return ModelResults(predictions, ahead)


def select(results: ModelResults, by: str = "mae") -> DataFrame:
    """Winner per product among the models left after the moving-average choice."""
    return FC.winners(FC.with_chosen_window(FC.metrics(results.predictions)), by)


def best_fitted(results: ModelResults, by: str = "mae") -> DataFrame:
    """Winner per product among the fitted models alone."""
    return FC.winners(FC.metrics(results.predictions.where(F.col("model").isin(FC.ETS, FC.FOREST))), by)


def multi_period(series: DataFrame, periods: int, best: DataFrame, forest: dict | None = None) -> DataFrame:
    """Forecasts of the next 1..``periods`` months by each product's winner (product, month, step, model, forecast).

    Products are dealt to the models once, by a written table; each model then forecasts its own products only, while the forest
    learns from all of them. Its steps feed each other; the other models know all steps at once. A product without a winner, or
    with an unknown one, gets the naive forecast. ``forest`` holds the settings of the forest, if any product may ask for it.
    """
    if not 1 <= periods <= 24:
        raise ValueError("periods must be between 1 and 24")
    known = [*FC.BASELINES, FC.ETS, *([FC.FOREST] if forest is not None else [])]
    asked = F.when(F.col("winner").isin(known), F.col("winner")).otherwise(FC.NAIVE)
    one = best.groupBy("product_id").agg(F.min("winner").alias("winner"))
    dealt = materialize(series.join(one, "product_id", "left").select("product_id", "month", "demand", asked.alias("winner")), "dealt")
    of = lambda model: dealt.where(F.col("winner") == model).drop("winner")
    baselines = dealt.where(F.col("winner").isin(FC.BASELINES))
    chosen = baselines.groupBy("product_id").agg(F.max("winner").alias("model"))
    out = FC.multi_period(baselines.drop("winner"), periods).join(chosen, ["product_id", "model"], "left_semi")
    out = out.unionByName(E.forecast_ets(of(FC.ETS), periods))
    if forest is not None and not of(FC.FOREST).isEmpty():
        out = out.unionByName(R.multi_period_forest(dealt.drop("winner"), periods, asked=of(FC.FOREST), **forest))
    return out


def portfolio(
    series: DataFrame, demand: DataFrame, results: ModelResults, by: str = "mae", classes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Winner and class per product, wins per class, and winners' errors per class; ``classes`` if not those of all products."""
    best, classes = select(results, by), A.abc(demand) if classes is None else classes
    per_product = best.join(classes.select("product_id", "abc", "total"), "product_id", "left")
    return per_product, FC.wins_by_class(best, classes), FC.errors_by_class(best, classes, by if by in FC.METRICS else "mae")


def recommend(
    series: DataFrame, demand: DataFrame, stock: DataFrame, results: ModelResults | None = None, *, test_months: int = 12,
    abc_class: str | None = None, top: int | None = None, cost_inventory: float = 1.0, cost_stockout: float = 5.0, lead_time: int = 1,
    classes: DataFrame | None = None,
) -> DataFrame:
    """What to produce next month for each product: forecast of its best model, safety stock, last stock, risk."""
    results = results or ModelResults(FC.backtest_baselines(series, test_months), FC.next_month(series))
    classes = A.abc(demand) if classes is None else classes
    if abc_class is not None:
        classes = classes.where(F.col("abc") == abc_class)
    if top is not None:
        classes = classes.orderBy(F.desc("total"), "product_id").limit(top)
    ahead = FC.forecast_with_winner(results.ahead, select(results), ["mae"]).drop("month")
    last = stock.groupBy("product_id").agg(F.max_by("stock", "month").alias("stock"))
    sigma = F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan("mae"), F.col("mae")), F.lit(0.0)))
    out = (
        P.policy_levels(classes).join(ahead, "product_id").join(last, "product_id", "left")
        .withColumns({"stock": F.coalesce("stock", F.lit(0.0)), "mae": sigma})
    )
    out = out.withColumn("ss", P.safety_stock(newsvendor_z(cost_stockout, cost_inventory), F.col("mae"), lead_time))
    return out.withColumns(
        {
            "production": F.ceil(F.round(P.production_quantity(F.col("forecast"), F.col("ss"), F.col("stock")), 9)),
            "at_risk": F.col("stock") < F.col("ss"),
        }
    ).select(
        "product_id", "abc", "winner", "forecast", "mae", "z_policy", "ss", "stock", "production", "at_risk", F.col("total").alias("total_demand")
    )


def portfolio_savings(
    series: DataFrame, stock: DataFrame, best: DataFrame, classes: DataFrame, *, abc_class: str = "A", min_months: int = 8,
    top: int | None = None, **costs: object,
) -> DataFrame:
    """Savings per product of one class: replays of every product with enough history, in one plan."""
    scope = classes.where(F.col("abc") == abc_class)
    if top is not None:
        scope = scope.orderBy(F.desc("total"), "product_id").limit(top)
    enough = series.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_months).select("product_id")
    chosen = best.join(scope.select("product_id"), "product_id", "left_semi").join(enough, "product_id", "left_semi")
    return P.comparison_kpis(P.replay_comparison(series, stock, chosen, **costs))
