"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandry.operators import build as B
from demandry.operators import forecast as FC
from demandry.operators import tenancy as N
from demandry.sources import tpch


def demand(spark: SparkSession, sf: str, by_brand: bool = False) -> DataFrame:
    return B.demand_monthly(tpch.ledger(spark, sf, "product_id", "month", "kind", "qty", by_brand=by_brand))


def series(spark: SparkSession, sf: str, by_brand: bool = False) -> DataFrame:
    return B.complete_series(demand(spark, sf, by_brand))


def stock(spark: SparkSession, sf: str, by_brand: bool = False) -> DataFrame:
    return B.stock_monthly(tpch.balanced_ledger(spark, sf, by_brand=by_brand))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return FC.metrics(FC.backtest_baselines(series(spark, sf)))


def best(spark: SparkSession, sf: str) -> DataFrame:
    return FC.winners(FC.with_chosen_window(scores(spark, sf)))


def scoped_inputs(spark: SparkSession, sf: str, opening: float = 10_000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Demand, series and stock of all organizations, products told apart by organization."""
    d = B.demand_monthly(tpch.ledger(spark, sf, "product_id", "month", "kind", "qty", by_org=True))
    s = B.complete_series(d, scope=N.organization_of())
    return d, s, B.stock_monthly(tpch.balanced_ledger(spark, sf, opening=opening, by_org=True))
