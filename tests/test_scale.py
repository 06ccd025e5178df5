"""Hot keys, block sums, percentiles and plan shapes."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import SF
from pyspark.sql import functions as F

from demandry import session
from demandry.functions.ordered import in_order, running_balance, with_group_totals
from demandry.functions.quantile import exact_percentiles
from demandry.operators import analytics as A
from demandry.operators import build as B
from demandry.operators import forecast as FC
from demandry.operators import policy as P
from demandry.operators import sqlapi as Q
from demandry.sources import tpch
from demandry.sources.files import number_parts
from suite import common


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows belong to one product, most of them on one day."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        p = "hot" if i % 3 == 0 else f"p{rng.integers(0, 40)}"
        day = dt.date(2024, 1, 15) if p == "hot" and i % 2 else dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 300)))
        rows.append((p, day, day.replace(day=1), i // 100, i, float(rng.integers(-9, 10))))
    return pd.DataFrame(rows, columns=["product_id", "date", "month", "row_block", "row_seq", "v"])


def test_running_balance_of_a_hot_product(spark, hot):
    df = spark.createDataFrame(hot)
    out = running_balance(df, F.col("v"), keys=["product_id"], coarse="month", fine=["date", "row_block"], order=["row_seq"], out="b")
    got = {r.row_seq: r.b for r in out.collect()}
    want = hot.sort_values(["product_id", "date", "row_seq"]).assign(b=lambda d: d.groupby("product_id")["v"].cumsum())
    assert got == dict(zip(want.row_seq, want.b))


def test_order_is_cut_also_inside_ties(spark, hot):
    tied = hot.assign(t=0.0)
    df = spark.createDataFrame(tied)
    out = in_order(df, keys=[], order=[F.desc("t"), F.asc("row_seq")], values={"s": F.col("v"), "r": F.lit(1)}, blocks=16)
    got = sorted((r.row_seq, r.r, r.s, r.s_total) for r in out.collect())
    total, run = tied.v.sum(), tied.sort_values("row_seq").v.cumsum()
    assert [g[1] for g in got] == list(range(1, 3001))
    assert [g[2] for g in got] == list(run) and {g[3] for g in got} == {total}


def test_rank_within_a_hot_key(spark, hot):
    out = Q.rank_within(spark.createDataFrame(hot), ["product_id"], [F.desc("v"), F.asc("row_seq")], "rank")
    want = hot.sort_values(["v", "row_seq"], ascending=[False, True]).assign(rank=lambda d: d.groupby("product_id").cumcount() + 1)
    assert {r.row_seq: r["rank"] for r in out.collect()} == dict(zip(want.row_seq, want["rank"]))


def test_hot_groups_are_dealt_over_copies(spark, hot):
    df = spark.createDataFrame(hot)
    totals = df.groupBy("product_id").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    out = with_group_totals(df, totals, ["product_id"], "n", F.col("row_seq"), hot_rows=50)
    assert out.count() == len(hot)
    want = hot.groupby("product_id").v.sum().to_dict()
    assert all(r.total == want[r.product_id] for r in out.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10])
def test_parts(spark, n):
    df = spark.range(0, 10)
    got = {r.id: r.part for r in number_parts(df, n, [F.asc("id")]).collect()}
    edges = [k * 10 // n for k in range(n + 1)]
    assert got == {i: next(k for k in range(n) if edges[k] <= i < edges[k + 1]) for i in range(10)}


@pytest.mark.parametrize("accuracy", [100, 20_000])
@pytest.mark.parametrize("kind", ["uniform", "ties", "outlier", "single", "two"])
def test_percentiles(spark, kind, accuracy):
    rng = np.random.default_rng(4)
    data = {
        "uniform": rng.normal(size=5000),
        "ties": rng.integers(0, 3, 5000).astype(float),
        "outlier": np.append(np.zeros(4999), 1e12),
        "single": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"a": data, "b": -data}))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.column, r.p): r.value for r in exact_percentiles(df, ["a", "b"], probs, accuracy).collect()}
    for p in probs:
        assert np.isclose(got["a", p], np.quantile(data, p)) and np.isclose(got["b", p], np.quantile(-data, p))


def test_percentiles_skip_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "a double")
    assert exact_percentiles(df, ["a"], [0.5]).first().value == 2.0


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_backtest_has_one_shuffle_and_no_python(spark):
    series = session.materialize(common.series(spark, SF), "plan")
    text = plan(FC.winners(FC.with_chosen_window(FC.metrics(FC.backtest_baselines(series))))).split("== Physical Plan ==")[1]
    assert text.count("Exchange hashpartitioning") == 1
    assert "Python" not in text


def test_scans_read_only_what_is_asked(spark):
    text = plan(tpch.ledger(spark, SF, "product_id", "kind", "qty").where("kind = 'sale' AND qty > 10"))
    physical = text.split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string>" in physical
    assert "GreaterThan(l_quantity,10.0)" in physical
    assert physical.count("FileScan") == 1


def test_stock_is_an_aggregate_with_partial_sums(spark, hot):
    df = spark.createDataFrame(hot).withColumnRenamed("v", "stock_after")
    physical = plan(B.stock_monthly(df)).split("== Physical Plan ==")[1]
    assert "partial_max_by" in physical and "Window" not in physical


def test_results_do_not_depend_on_partitioning(spark):
    rows = tpch.ledger(spark, SF, "product_id", "month", "kind", "qty")
    few, many = (B.complete_series(B.demand_monthly(rows.repartition(k))).collect() for k in (1, 13))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


class _Session:
    """Stands in for a session: only what the folder choice looks at."""

    def __init__(self, configured, master):
        self.conf = self
        self.sparkContext = self
        self._dir, self.master, self.applicationId = configured, master, f"app-{configured}-{master}"

    def get(self, key, default=None):
        return self._dir if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_configured_one():
    assert session.fresh_path(_Session("hdfs://nn/shared/", "yarn"), "x").startswith("hdfs://nn/shared/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(None, "yarn"))
    local = _Session(None, "local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_percentile_values_are_not_gathered_by_bracket(spark):
    """A million different values in one bracket: they are looked at block by block, and only the brackets' rows meet."""
    df = spark.range(1_000_000).select((F.col("id") * 7 % 1_000_003).cast("double").alias("a"))
    out = exact_percentiles(df, ["a"], [0.5], accuracy=16)
    text = plan(out).split("== Physical Plan ==")[1]
    assert "SortMergeJoin [bracket" not in text and "ShuffledHashJoin [bracket" not in text
    assert "BroadcastHashJoin [bracket" in text
    a = (np.arange(1_000_000, dtype=np.int64) * 7) % 1_000_003
    assert out.first().value == np.quantile(a, 0.5)


def test_replays_read_each_table_once(spark):
    """Histories meet in one exchange by product; the months are worked out from them without another."""
    kept = lambda df: session.materialize(df, "plan")
    series, stock = kept(common.series(spark, SF)), kept(common.stock(spark, SF))
    best, classes = kept(common.best(spark, SF)), kept(A.abc(common.demand(spark, SF)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, tables in ((P.replay_policy(series, stock, best, classes), 4), (P.comparison_kpis(P.replay_comparison(series, stock, best)), 3)):
            text = plan(out).split("== Physical Plan ==")[1]
            assert text.count("FileScan parquet") == tables
            assert text.count("Exchange hashpartitioning(product_id") == tables - 1
            assert "Python" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
