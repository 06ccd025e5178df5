"""What grows with the tables: broadcasts, merged partitions, tables worked out twice."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import series_frame
from pyspark.sql import functions as F

from demandry.functions.ordered import running_balance
from demandry.operators import build as B
from demandry.operators import forecast as FC
from demandry.operators import forest as R
from demandry.session import materialize
from demandry.sources import files, tpch
from suite import QUERIES, analytics, sources, streams


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture
def written(monkeypatch):
    """Names and plans of the tables that a module writes to the shared folder."""
    seen = {}

    def into(module):
        monkeypatch.setattr(module, "materialize", lambda df, name: (seen.setdefault(name, []).append(plan(df)), materialize(df, name))[1])
        return seen

    return into


class Stop(Exception):
    pass


def _stop(*_, **__):
    raise Stop


def _series(spark):
    rng = np.random.default_rng(7)
    return materialize(series_frame(spark, {f"p{k}": [float(v) for v in rng.poisson(10 + k, 30)] for k in range(3)}), "few")


@pytest.mark.parametrize("mode", ["reference", "advanced"])
def test_forest_backtest_has_no_join_and_reads_once_for_each_fit(spark, written, mode):
    seen, s = written(R), _series(spark)
    out = R.backtest_forest(s, 4, trees=2, depth=2, refit_every=2, mode=mode)
    (training,) = seen["training"]
    assert "Join" not in training and training.count("Exchange hashpartitioning(product_id") == 1
    assert plan(out).count("FileScan parquet") == 2
    assert out.count() == 3 * 4 and out.where("y_true IS NULL OR y_pred < 0").isEmpty()


def test_forest_steps_ahead_have_no_shuffle(spark, written):
    seen, s = written(R), _series(spark)
    out = R.multi_period_forest(s, 3, trees=2, depth=2)
    assert len(seen["step"]) == 3 and not [p for p in seen["step"] if "Exchange" in p or "Join" in p or "Window" in p]
    assert out.count() == 3 * 3 and out.where("forecast IS NULL OR forecast < 0").isEmpty()


def test_features_after_are_those_of_the_next_month(spark):
    rng = np.random.default_rng(8)
    some = {f"p{n}": [float(v) * 1.1 for v in rng.poisson(1.5, n)] for n in (1, 2, 3, 5, 7, 12, 13, 30)}
    s = series_frame(spark, {**some, "gap": [1.5, -1.0, 0.0, 2.5, -1.0, 3.1]})
    s = s.withColumn("demand", F.expr("nullif(demand, -1)"))
    h = s.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("month", "demand")), asc=False).alias("h"), F.max("month").alias("month"))
    after = FC.with_calendar(h.select("product_id", F.add_months("month", 1).alias("month"), F.slice(F.col("h.demand"), 1, 12).alias("h")).withColumns(FC.features_after(F.col("h"))))
    columns = ["product_id", "month", *FC.FEATURES]
    want = FC.next_month_features(s, "advanced").select(columns).orderBy("product_id").collect()
    assert after.select(columns).orderBy("product_id").collect() == want


def test_forest_backtest_asks_with_the_row_before(spark):
    """In the reference's way a month is asked for with the lags of the month before it: here one unit lower each."""
    s = series_frame(spark, {"up": [float(v) for v in range(40)]})
    kept = {}
    whole = R.materialize
    R.materialize = lambda df, name: kept.setdefault(name, whole(df, name))
    try:
        R.backtest_forest(s, 2, trees=2, depth=2)
    finally:
        R.materialize = whole
    last = kept["training"].orderBy(F.desc("month")).first()
    # Month 39: its own lag is 38 over a level of 32.5, that of the row before 37 over 31.5.
    assert last.features[0] == pytest.approx(38 / 32.5) and last.ask[0] == pytest.approx(37 / 31.5) and last.ask_level == 31.5
    assert last.features[-3] == last.ask[-3] == last.month.month and last.y_true == 39.0


def test_forecasts_train_on_a_written_table(spark, written):
    seen, s = written(R), _series(spark)
    assert R.next_month_forest(s, trees=2, depth=2).count() == 3
    assert R.multi_period_forest(s, 1, trees=2, depth=2).count() == 3
    assert len(seen["training"]) == 2


def test_completed_series_keep_all_partitions(spark):
    demand = series_frame(spark, {f"p{k}": [1.0, 2.0] for k in range(40)})
    out = B.complete_series(demand, end="2029-12-01")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == 40 * 120 and B.complete_series(demand).rdd.getNumPartitions() == 8


def test_balances_of_hot_and_other_months(spark):
    rows = [("hot" if i % 2 else f"p{i % 7}", i % 3, i % 5, i, float(i % 11 - 5)) for i in range(900)] + [(None, 0, 0, 1, 1.0), ("hot", None, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "product_id string, month int, day int, row_seq int, v double")
    out = {}
    for hot_rows in (100, 10_000):
        got = running_balance(df, F.col("v"), keys=["product_id"], coarse="month", fine=["day"], order=["row_seq"], out="b", hot_rows=hot_rows)
        out[hot_rows] = {r.row_seq: (r.product_id, r.b) for r in got.collect()}
    want, run = {}, {}
    for p, _, _, i, v in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        run[p] = run.get(p, 0.0) + v
        want[i] = (p, run[p])
    assert out[100] == out[10_000] == want


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_balances_of_rows_without_a_value(spark, hot_rows):
    """Such a row has the balance so far, or none if its block has no value yet; sums go on after it."""
    rows = [("a", 1, 1, 1, 5.0), ("a", 1, 1, 2, None), ("a", 1, 2, 3, None), ("a", 1, 2, 4, 2.0), ("a", 2, 1, 5, None), ("a", 2, 2, 6, 1.0)]
    df = spark.createDataFrame(rows, "product_id string, month int, day int, row_seq int, v double")
    got = running_balance(df, F.col("v"), keys=["product_id"], coarse="month", fine=["day"], order=["row_seq"], out="b", hot_rows=hot_rows)
    assert {r.row_seq: r.b for r in got.collect()} == {1: 5.0, 2: 5.0, 3: None, 4: 7.0, 5: None, 6: 8.0}


def test_balances_shuffle_rows_by_month_not_by_block(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(tpch.balanced_ledger(spark, sf))
        wide = plan(tpch.ledger(spark, sf, "client", "department", "qty"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "row_block" not in " ".join(x for x in text.splitlines() if "Exchange hashpartitioning" in x)
    # Lines are below no exchange by customer.
    by_customer = wide[wide.index("Exchange hashpartitioning(o_custkey") :].split("Exchange", 2)[1]
    assert "l_orderkey" not in by_customer and "o_orderkey" in by_customer


def test_arrivals_are_cut_from_one_written_ledger(spark, sf, monkeypatch, written):
    for module, name, end in ((streams, "ingest_demand", (streams.ingest, "ingest")), (streams, "tenant_layouts", (files, "write_csv")), (sources, "csv_many_files", (files, "write_csv"))):
        seen = written(module)
        with monkeypatch.context() as m:
            m.setattr(*end, _stop)
            with pytest.raises(Stop):
                QUERIES[name](spark, sf)
        assert len(seen.pop("raw")) == 1
    seen = written(analytics)
    QUERIES["stage_counts"](spark, sf)
    assert len(seen["raw"]) == 1


@pytest.mark.parametrize("name", ["legacy_to_stock", "legacy_to_demand", "ties_in_given_order", "warehouse_balance_over_files"])
def test_files_in_order_are_written_by_all_partitions(spark, sf, monkeypatch, name):
    given = []
    monkeypatch.setattr(files, "write_csv", lambda df, *_, **__: (given.append(plan(df)), _stop()))
    with pytest.raises(Stop):
        QUERIES[name](spark, sf)
    assert "rangepartitioning" in given[0] and ", 4)" not in given[0][given[0].index("rangepartitioning") :].split("\n")[0]


def test_a_single_file_is_not_read_by_a_single_task(spark, sf, monkeypatch):
    given = []
    monkeypatch.setattr(files, "write_csv", lambda df, *_, **__: (given.append(plan(df)), _stop()))
    with pytest.raises(Stop):
        QUERIES["file_inventory"](spark, sf)
    assert "Coalesce" not in given[0] and "Exchange SinglePartition" in given[0]
