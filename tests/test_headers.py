"""Files judged one by one: headers in one job, refusal by name, quarantine, layouts from configuration rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.plans import load
from demandry.sources import files, layouts
from demandry.sources import headers as H
from demandry.streaming import ingest

HEAD = ",".join(S.REQUIRED)
ROW = "2024-01-05,{p},n,Venta,5,10,5"


def put(path, *rows, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join([*rows, ""]).encode(encoding))
    return str(path)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_bad_file_beside_good_ones_is_named(spark, tmp_path):
    put(tmp_path / "in" / "good.csv", HEAD, ROW.format(p="P1"))
    put(tmp_path / "in" / "x.csv", "foo,bar", "1,2")
    error = load.run(spark, [str(tmp_path / "in")]).error
    assert "x.csv" in error and "Cantidad" in error and "foo" in error and "good.csv" not in error
    put(tmp_path / "few" / "good.csv", HEAD, ROW.format(p="P1"))
    for i in range(3):
        put(tmp_path / "few" / f"y{i}.csv", HEAD.replace(",Cantidad", ""), "2024-01-05,P1,n,Venta,10,5")
    with pytest.raises(H.MissingColumns, match=r"y0.csv and 2 more: missing columns \['Cantidad'\]"):
        files.read_ledger(spark, [str(tmp_path / "few")])
    old = "Codigo;Fecha;Documento;Entrada_unid;Salida_unid;Saldo_unid"
    put(tmp_path / "old" / "a.csv", old, "P1;2024-01-01;VO;0;1;9")
    put(tmp_path / "old" / "b.csv", "p;q", "1;2")
    assert "b.csv: missing columns ['Codigo'" in load.run(spark, [str(tmp_path / "old")]).error


def test_header_jobs_do_not_grow_with_the_files(spark, tmp_path):
    for folder, n in (("three", 3), ("many", 400)):
        for i in range(n):
            put(tmp_path / folder / f"{i}.csv", HEAD if i % 2 else HEAD + ",Canal_venta", ROW.format(p=f"P{i}"))
    few = jobs_of(spark, "few", lambda: H.headers(H.file_table(spark, [str(tmp_path / "three")])))
    many = jobs_of(spark, "many", lambda: H.headers(H.file_table(spark, [str(tmp_path / "many")])))
    # Spark lists a folder of many files by a job of its own.
    assert many <= few + 1
    assert files.read_ledger(spark, [str(tmp_path / "many")]).count() == 400


def test_odd_names_and_headers(spark, tmp_path):
    put(tmp_path / "a b" / "x+y é.csv", "", "  ", "﻿" + HEAD, ROW.format(p="P1"))
    put(tmp_path / "a b" / "twice.csv", HEAD + ",Nota,nota,", ROW.format(p="P2") + ",1,2,3")
    put(tmp_path / "a b" / "blank.csv", "", " ")
    table = H.file_table(spark, [str(tmp_path / "a b"), str(tmp_path / "a b" / "twice.csv"), str(tmp_path / "a*" / "tw*.csv")])
    got = sorted((r.source_no, r.path.rsplit("/", 1)[-1]) for r in table.collect())
    assert got == [(0, "blank.csv"), (0, "twice.csv"), (0, "x+y é.csv"), (1, "twice.csv"), (2, "twice.csv")]
    heads = H.headers(table)
    assert [list(h.places)[7:] for h in heads if h.source_no == 1] == [["Nota7", "nota8"]]
    judged = H.judged(table, heads, S.REQUIRED)
    assert {r.path.rsplit("/", 1)[-1]: r.verdict for r in judged.collect()} == {"blank.csv": H.EMPTY, "twice.csv": H.GOOD, "x+y é.csv": H.GOOD}


def test_files_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    p = put(tmp_path / "a.csv", "", HEAD, ROW.format(p="P1"))
    listed = H.list_files(spark, [p]).withColumn("encoding", F.lit("UTF-8"))
    far = listed.withColumn("path", F.concat(F.lit("file://localhost"), F.replace("path", F.lit("file:"), F.lit(""))))
    monkeypatch.setattr(H, "_store", lambda path: (_ for _ in ()).throw(OSError(path)))
    assert H._first_line(p, "UTF-8") == (None, False)
    assert far.count() == 1
    monkeypatch.undo()
    table = H.with_headers(listed)
    assert table.first().header == HEAD


MAPPING = {"product": "SKU", "date": "Día", "quantity": "Uds"}


def _config(spark, *rows):
    return spark.createDataFrame(rows, "organization_id string, csv_separator string, csv_encoding string, column_mapping string")


def test_tenants_of_several_layouts_in_one_load(spark, tmp_path):
    root = tmp_path / "root"
    put(root / "a" / "raw" / "1.csv", "SKU|Día|Uds", "ñ1|2024-01-05|3", encoding="ISO-8859-1")
    put(root / "a" / "raw" / "2.csv", "Uds|SKU|Día|x", "4|ñ2|2024-01-06|q", encoding="ISO-8859-1")
    put(root / "a" / "raw" / "bad.csv", "SKU|Uds", "ñ3|9", encoding="ISO-8859-1")
    put(root / "b+c d" / "1.csv", "producto,fecha,cantidad,empresa", "p,2024-02-01,5,E")
    put(root / "c" / "1.csv", "producto,fecha", "p,2024-02-01")
    put(root / "d" / "1.csv", "SKU", "1")
    put(root / "e" / "1.csv", "SKU", "1")
    put(root / "loose.csv", "SKU", "1")
    config = _config(
        spark, ("a", "|", "ISO-8859-1", json.dumps(MAPPING, ensure_ascii=False)), ("b+c d", None, None, None), ("c", ",", "utf-8", None),
        ("e", ",", "utf-8", "no json"),
    )
    got = layouts.read_tenants(spark, str(root), config, ["product", "quantity"])
    rows = {(r.org_id, r["product"], r.date, r.quantity) for r in got.rows.collect()}
    assert rows == {("a", "ñ1", "2024-01-05", "3"), ("a", "ñ2", "2024-01-06", "4"), ("b+c d", "p", "2024-02-01", "5")}
    seen = {(r.org_id, r.path.rsplit("/", 1)[-1]): (r.verdict, tuple(r.missing or ())) for r in got.refused.collect()}
    assert seen == {
        ("a", "bad.csv"): (H.LACKING, ("Día",)), ("c", "1.csv"): (H.LACKING, ("cantidad", "empresa")),
        ("d", "1.csv"): (H.NO_LAYOUT, ("product", "quantity")), ("e", "1.csv"): (H.NO_LAYOUT, ("product", "quantity")),
        (None, "loose.csv"): (H.NO_LAYOUT, ("product", "quantity")),
    }
    nothing = layouts.read_tenants(spark, str(root / "d"), config, ["product"])
    assert nothing.rows is None and nothing.refused.count() == 1


def test_ingest_keeps_a_bad_file_apart(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ingest.Store(str(tmp_path / "store"))
    put(inbox / "x.csv", "foo,bar", "1,2", "", "3,4")
    put(inbox / "a.csv", HEAD, ROW.format(p="P1"))
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    assert spark.read.parquet(store.path("ledger")).count() == 1
    refused = ingest.quarantine(spark, store)
    r = refused.first()
    assert refused.count() == 1 and r.path.endswith("x.csv") and r.verdict == H.LACKING and "Cantidad" in r.missing and r.batch_id == 0
    assert H.data_lines(refused).first().n_lines == 2
    audit = spark.read.parquet(store.path("audit")).first()
    assert (audit.n_raw, audit.n_clean, audit.n_demand, audit.n_stock) == (1, 1, 1, 1)


def test_ingest_of_bad_files_alone(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ingest.Store(str(tmp_path / "store"))
    assert ingest.quarantine(spark, store).count() == 0
    put(inbox / "x.csv", "foo,bar", "1,2")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    assert ingest.quarantine(spark, store).count() == 1 and not H.exists(spark, store.path("ledger"))


def test_ingest_by_organization_keeps_products_apart(spark, tmp_path):
    inbox, store = tmp_path / "inbox", ingest.Store(str(tmp_path / "store"))
    same = json.dumps({c: c for c in S.REQUIRED}, ensure_ascii=False)
    config = _config(spark, ("o1", ",", "utf-8", same), ("o2", ";", "utf-8", same))
    put(inbox / "o1" / "raw" / "a.csv", HEAD, ROW.format(p="P"), "2024-02-01,P,n,Venta,1,5,4")
    put(inbox / "o2" / "raw" / "a.csv", HEAD.replace(",", ";"), "2024-01-09;P;n;Venta;7;9;2")
    put(inbox / "o2" / "raw" / "bad.csv", "p;q", "1;2")
    read = lambda: {(r.org_id, str(r.month), r.demand) for r in spark.read.parquet(store.path("demand_monthly")).collect()}
    ingest.ingest(spark, str(inbox), store, config=config).awaitTermination()
    assert read() == {("o1", "2024-01-01", 5.0), ("o1", "2024-02-01", 1.0), ("o2", "2024-01-01", 7.0)}
    put(inbox / "o2" / "raw" / "b.csv", HEAD.replace(",", ";"), "2024-01-10;P;n;Venta;1;2;1")
    ingest.ingest(spark, str(inbox), store, config=config).awaitTermination()
    assert read() == {("o1", "2024-01-01", 5.0), ("o1", "2024-02-01", 1.0), ("o2", "2024-01-01", 8.0)}
    stock = {(r.org_id, str(r.month), r.stock) for r in spark.read.parquet(store.path("stock_monthly")).collect()}
    assert stock == {("o1", "2024-01-01", 5.0), ("o1", "2024-02-01", 4.0), ("o2", "2024-01-01", 1.0)}
    assert [(r.org_id, r.batch_id) for r in ingest.quarantine(spark, store).collect()] == [("o2", 0)]
    batch = layouts.read_tenants(spark, str(inbox), config, S.REQUIRED).rows.where("source_file = 'b.csv'")
    ingest.apply_batch(batch, 1, store, ["org_id"])
    assert read() == {("o1", "2024-01-01", 5.0), ("o1", "2024-02-01", 1.0), ("o2", "2024-01-01", 8.0)}
