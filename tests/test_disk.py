"""What the queries over written ledgers hold on disk: compressed files, and no table that is not read any more."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from demandry import session
from demandry.functions.ordered import running_balance, running_balance_by_key
from demandry.sources import files, tpch
from demandry.sources import headers as H
from demandry.streaming import ingest
from suite import QUERIES


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    return tmp_path


def held(folder) -> set[str]:
    return {p.name.rsplit("-", 1)[0] for p in folder.iterdir()}


def plain_files(folder) -> list[str]:
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".csv")]


@pytest.mark.parametrize(
    "name, tables",
    [
        ("csv_ledger_scan", {"csv", "files"}),
        ("csv_clean_to_stock", {"csv", "files"}),
        ("csv_many_files", {"years", "files"}),
        ("stage_counts", {"raw", "movements"}),
        ("ingest_demand", {"ingest", "files"}),
        ("ingest_by_organization", {"tenants", "files"}),
        ("tenant_layouts", {"tenants", "files"}),
        ("load_to_store", {"stored", "files"}),
    ],
)
def test_written_ledgers_leave_only_what_is_read(spark, sf, folder, name, tables):
    assert QUERIES[name](spark, sf).count() > 0
    assert held(folder) == tables and not plain_files(folder)


def test_wide_ledger_by_groups_of_products(spark, sf, folder, monkeypatch):
    """However many groups the lines are cut into, the ledger is the same, and the lines are gone."""
    out = []
    for n in (1, 3):
        monkeypatch.setattr(tpch, "parts_for", lambda _, n=n: n)
        out.append(sorted(map(str, tpch.raw_ledger(spark, sf, places=True, org=True).collect())))
    assert out[0] == out[1] and len(out[0]) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert held(folder) == {"wide"}


def test_balances_shuffle_rows_once_unless_a_key_is_hot(spark):
    df = spark.createDataFrame([(f"p{i % 5}", i % 3, i, 1.0) for i in range(60)], "product_id string, month int, row_seq int, v double")
    out = running_balance_by_key(df, F.col("v"), keys=["product_id"], coarse="month", fine=[], order=["row_seq"], out="b")
    text = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert text.count("Exchange") == 1 and "Join" not in text
    assert sorted(r.b for r in out.collect()) == sorted(float(k) for k in range(1, 13) for _ in range(5))


def test_balances_by_key_are_those_by_month(spark):
    """With hot keys, rows without a value and rows without a place: the same as by months."""
    rows = [("hot" if i % 2 else f"p{i % 7}", i % 3, i % 5, i, None if i % 13 == 0 else float(i % 11 - 5)) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, 0, 0, 1, 1.0), ("hot", None, 0, 1, 1.0)], "product_id string, month int, day int, row_seq int, v double")
    given = {"keys": ["product_id"], "coarse": "month", "fine": ["day"], "order": ["row_seq"], "out": "b"}
    want = {r.row_seq: (r.product_id, r.b) for r in running_balance(df, F.col("v"), **given).collect()}
    assert len(want) == 900
    for hot_rows in (20, 100, 10_000):
        got = running_balance_by_key(df, F.col("v"), hot_rows=hot_rows, **given).collect()
        assert {r.row_seq: (r.product_id, r.b) for r in got} == want


def test_sparing_keeps_what_is_taken_out(spark, folder):
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    with session.sparing(spark) as paths:
        session.materialize(spark.range(3).toDF("a"), "gone")
        stays = session.materialize(spark.range(5).toDF("a"), "stays")
        paths.pop()
    assert held(folder) == {"stays"} and stays.count() == 5
    assert spark.conf.get("spark.sql.parquet.compression.codec") == before


@pytest.mark.parametrize("n", [1, 3])
def test_batches_are_worked_off_in_parts_of_months(spark, folder, monkeypatch, n):
    """Every month of every part has its tables, and of two files the later one ends a day."""
    monkeypatch.setattr(ingest, "parts_for", lambda _: n)
    rows = [
        (f"2024-{m:02d}-05", "p", "n", "Producción", str(q), "0", str(q), "f", 0, f, 0, 1)
        for m in range(1, 8) for f, q in (("file:/z", 3 * m), ("file:/a", 5 * m))
    ]
    names = ["Fecha", "Producto_id", "Producto_nombre", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior"]
    raw = spark.createDataFrame([*rows, (None, *rows[0][1:])], [*names, "source_file", "source_no", "source_path", "row_block", "row_seq"])
    store = ingest.Store(f"{folder}/store")
    ingest.apply_batch(raw, 0, store)
    ingest.apply_batch(raw.where("Fecha < '2024-03'"), 1, store)
    audit = spark.read.parquet(store.path("audit")).orderBy("batch_id").select("n_raw", "n_clean", "n_demand", "n_stock").collect()
    assert [tuple(r) for r in audit] == [(15, 14, 0, 7), (4, 4, 0, 2)]
    stock = {r.month.month: r.stock for r in spark.read.parquet(store.path("stock_monthly")).collect()}
    assert stock == {m: 3.0 * m for m in range(1, 8)}
    assert held(folder) == {"store"}


def test_ranks_of_files_stand_for_their_paths(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "source_path string, row_seq int")
    ranked, order = files.ranked_sources(rows, ["date", "source_no", "source_path", "source_file", "row_seq"])
    assert order == ["date", "source_no", "source_rank", "row_seq"]
    ranks = {r.row_seq: r.source_rank for r in ranked.collect()}
    assert len(ranks) == 4 and ranks[1] == ranks[4] > ranks[2]


def test_lines_of_compressed_refused_files_are_counted(spark, folder):
    """A refused file that is compressed holds back the same rows, and its header is read as well."""
    rows = spark.range(50).selectExpr("id AS a", "concat('x', id) AS b").coalesce(1)
    for name, kind in (("plain", None), ("packed", "gzip")):
        files.write_csv(rows, f"{folder}/{name}", compression=kind)
        table = H.file_table(spark, [f"{folder}/{name}"])
        assert [(h.line, h.n_files) for h in H.headers(table)] == [("a,b", 1)]
        assert [r.n_lines for r in H.data_lines(table).collect()] == [50]
    assert [f.name.endswith(".csv.gz") for f in (folder / "packed").iterdir() if f.name.startswith("part-")] == [True]
