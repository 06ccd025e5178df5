from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.operators import sqlapi as Q
from demandry.operators import tenancy as N
from demandry.plans import load
from demandry.sources import files, snapshot
from demandry.streaming import ingest, live


def lines(path, *rows, encoding="utf-8"):
    path.write_text("\n".join(rows) + "\n", encoding=encoding)
    return str(path)


HEAD = "Fecha,Producto_id,Producto_nombre,Tipo_movimiento,Cantidad,Stock_anterior,Stock_posterior"


def test_headers_are_tidied_and_rows_keep_their_order(spark, tmp_path):
    p = lines(tmp_path / "a.csv", " Fecha ,Producto_id,Unnamed: 2", "2024-01-01,P1,x", "2024-01-01,P2,y")
    df = files.read_text_csv(spark, p)
    assert df.columns == ["Fecha", "Producto_id", "source_file", "source_no", "source_path", "row_block", "row_seq"]
    assert [r.Producto_id for r in df.orderBy("row_seq").collect()] == ["P1", "P2"]
    assert {r.source_file for r in df.collect()} == {"a.csv"}


def test_load_reports_errors(spark, tmp_path):
    bad = lines(tmp_path / "bad.csv", "Fecha,Producto_id", "2024-01-01,P1")
    r = load.run(spark, [bad])
    assert not r.ok and "Cantidad" in r.error
    empty = lines(tmp_path / "none.csv", HEAD, "x,P1,n,Venta,5,10,5")
    assert "no valid rows" in load.run(spark, [empty]).error


def test_formats_are_told_apart(spark, tmp_path):
    v4 = lines(tmp_path / "v4.csv", HEAD, "2024-01-05,P1,n,Venta,5,10,5")
    old = lines(
        tmp_path / "old.csv", "Codigo;Fecha;Documento;Numero;Bodega;Entrada_unid;Salida_unid;Saldo_unid", "P1;2024-01-05;VO;1;W;0;2,5;9", "P1;2024-03-05;GU;7;W;0;4;5",
        "P1;2024-03-06;GU;8;W;3;0;8", "P1;x;VO;1;W;0;1;1",
    )
    assert "mixed" in load.run(spark, [v4, old]).error
    assert load.run(spark, []).error
    r = load.run(spark, [old])
    assert r.ok and r.movements.count() == 3
    assert [(x.month.month, x.demand) for x in r.demand_monthly.orderBy("month").collect()] == [(1, 2.5), (2, 0.0), (3, 4.0)]
    assert [(x.warehouse, x.month.month, x.stock) for x in r.stock_monthly.orderBy("month").collect()] == [("W", 1, 9.0), ("W", 3, 8.0)]


def test_load_end_to_end(spark, tmp_path):
    a = lines(tmp_path / "a.csv", HEAD, "2024-01-05,P1,n,Venta,5,10,5", "2024-01-20,P1,n,Venta,2,5,3", "2024-02-01,P1,n,Producción,9,3,12")
    b = lines(tmp_path / "b.csv", HEAD + ",Canal_venta", "05/02/2024,P1,n,Venta,4,12,8,Online", "06/02/2024,P1,n,Venta,4,8,99,Online")
    r = load.run(spark, [a, b])
    assert r.ok and r.movements.count() == 4
    d = {x.month: x.demand for x in r.demand_monthly.collect()}
    assert d == {dt.date(2024, 1, 1): 7.0, dt.date(2024, 2, 1): 4.0}
    s = {x.month: x.stock for x in r.stock_monthly.collect()}
    assert s == {dt.date(2024, 1, 1): 3.0, dt.date(2024, 2, 1): 8.0}


def test_tenant_folder_is_guarded():
    assert files.guard_tenant("/b/org1/raw/x.csv", "/b", "org1") == "/b/org1/raw/x.csv"
    for bad in ("/b/org10/raw/x.csv", "/b/org1/../org2/x.csv", "/other/org1/x.csv"):
        with pytest.raises(PermissionError):
            files.guard_tenant(bad, "/b", "org1")


def test_years_not_found_are_listed(spark, tmp_path):
    (tmp_path / "o" / "raw").mkdir(parents=True)
    lines(tmp_path / "o" / "raw" / "data_2023.csv", "a,b", "1,2", "3,4")
    found, absent = files.load_years(spark, str(tmp_path), "o", [2022, 2023])
    assert list(found) == [2023] and absent == [2022]
    assert Q.query(spark, "SELECT sum(a) AS s FROM data_2023").first().s == 4


def test_erp_report(spark, tmp_path):
    p = tmp_path / "erp.csv"
    lines(p, "Período: 2025;;;", "Código;Descripción;Unidades;Unidades", "'A1';Caja;3;4", ";;;", "'B2';Tapa;1;0", encoding="latin-1")
    got = files.read_erp_report(spark, str(p), ["code", "description", "u_in", "u_out"]).orderBy("code").collect()
    assert [tuple(r) for r in got] == [("A1", "Caja", "3", "4"), ("B2", "Tapa", "1", "0")]


def test_legacy_decimals(spark, tmp_path):
    p = lines(tmp_path / "l.csv", "Codigo;Fecha;Documento;Entrada_unid;Salida_unid;Saldo_unid", "A;2024-01-01;VO;0,5;1,25;x")
    r = files.read_legacy(spark, p).first()
    assert (r.Entrada_unid, r.Salida_unid, r.Saldo_unid) == (0.5, 1.25, None)


def test_csv_round_trip_keeps_blanks(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1.5)], "t string, v double")
    files.write_csv(df, str(tmp_path / "out"), sep=";", decimal=",")
    r = files.read_text_csv(spark, str(tmp_path / "out"), ";").first()
    assert (r.t, r.v) == (" a ", "1,5")


def test_snapshot_replaces_only_its_organizations(spark, tmp_path):
    mk = lambda org, v: spark.createDataFrame([(org, v)], "org_id string, v int")
    root = str(tmp_path / "snap")
    both = mk("a", 1).union(mk("b", 2))
    snapshot.save_snapshot({"t": both}, root, both, 2)
    snapshot.save_snapshot({"t": mk("a", 9)}, root, mk("a", 9), 5)
    assert {(r.org_id, r.v) for r in snapshot.load_snapshot(spark, root, "t").collect()} == {("a", 9), ("b", 2)}
    assert [r.v for r in snapshot.load_snapshot(spark, root, "t", "b").collect()] == [2]
    fresh = {r.org_id: r.files_processed for r in snapshot.freshness(spark.read.parquet(root + "/manifest")).collect()}
    assert fresh == {"a": 5, "b": 2}


def test_aggregate_refuses_other_operations(spark):
    with pytest.raises(ValueError, match="median"):
        Q.aggregate(spark.range(3), ["id"], {"id": "median"})


def test_ingest_twice_changes_nothing(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    rows = [("2024-01-05", "P1", "n", "Venta", "5", "10", "5"), ("2024-02-05", "P1", "n", "Venta", "1", "5", "4")]
    fields = HEAD.split(",")
    one = spark.createDataFrame(rows, S.text_schema(fields))
    two = spark.createDataFrame([("2024-02-06", "P1", "n", "Venta", "2", "4", "2"), ("bad", "P1", "n", "Venta", "2", "2", "0")], S.text_schema(fields))
    read = lambda t: sorted(map(tuple, spark.read.parquet(store.path(t)).select("product_id", "month", t.split("_")[0]).collect()))
    ingest.apply_batch(one, 0, store)
    ingest.apply_batch(two, 1, store)
    first = read("demand_monthly"), read("stock_monthly")
    assert first[0] == [("P1", dt.date(2024, 1, 1), 5.0), ("P1", dt.date(2024, 2, 1), 3.0)]
    assert first[1] == [("P1", dt.date(2024, 1, 1), 5.0), ("P1", dt.date(2024, 2, 1), 2.0)]
    ingest.apply_batch(two, 1, store)
    assert (read("demand_monthly"), read("stock_monthly")) == first
    audit = {r.batch_id: (r.n_raw, r.n_clean, r.n_demand, r.n_stock) for r in spark.read.parquet(store.path("audit")).collect()}
    assert audit == {0: (2, 2, 2, 2), 1: (2, 1, 1, 1)}


def test_ingest_reads_each_file_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = ingest.Store(str(tmp_path / "store"))
    lines(inbox / "a.csv", HEAD, "2024-01-05,P1,n,Venta,5,10,5")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    lines(inbox / "b.csv", HEAD, "2024-01-09,P1,n,Venta,1,5,4")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    assert spark.read.parquet(store.path("ledger")).count() == 2
    assert spark.read.parquet(store.path("demand_monthly")).first().demand == 6.0


def test_live_view_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, k string, v double"
    src = str(tmp_path / "src")
    put = lambda rows: spark.createDataFrame([(dt.datetime.fromisoformat(t), k, v) for t, k, v in rows], schema).coalesce(1).write.mode("append").parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    go = lambda: live.start_daily(live.daily_totals(live.read_events(spark, src, spark.createDataFrame([], schema).schema), "k", "v"), out, ck).awaitTermination()
    put([("2024-01-01T10:00:00", "a", 1.0), ("2024-01-01T11:00:00", "a", 2.0), ("2024-01-08T00:00:00", "a", 5.0)])
    go()
    put([("2024-01-01T12:00:00", "a", 100.0), ("2024-01-20T00:00:00", "a", 7.0)])
    go()
    got = {(r.day, r.k): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {(dt.date(2024, 1, 1), "a"): (2, 3.0), (dt.date(2024, 1, 8), "a"): (1, 5.0)}


def test_ingest_of_batches_without_sales_or_rows(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    store = ingest.Store(str(tmp_path / "store"))
    lines(inbox / "a.csv", HEAD, "bad,P1,n,Venta,5,10,5")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    lines(inbox / "b.csv", HEAD, "2024-01-05,P1,n,Producción,5,10,15")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    swapped = HEAD.replace("Producto_id,Producto_nombre", "Producto_nombre,Producto_id")
    lines(inbox / "c.csv", swapped, "2024-01-06,name,P1,Venta,4,15,11")
    ingest.ingest(spark, str(inbox), store).awaitTermination()
    audit = {r.batch_id: (r.n_raw, r.n_clean, r.n_demand, r.n_stock) for r in spark.read.parquet(store.path("audit")).collect()}
    assert audit == {0: (1, 0, 0, 0), 1: (1, 1, 0, 1), 2: (1, 1, 1, 1)}
    assert [tuple(r) for r in spark.read.parquet(store.path("demand_monthly")).select("product_id", "demand").collect()] == [("P1", 4.0)]
    assert [tuple(r) for r in spark.read.parquet(store.path("stock_monthly")).select("product_id", "stock").collect()] == [("P1", 11.0)]


def test_columns_go_by_name(spark, tmp_path):
    """Header orders within a folder, a column that begins like a blank one's name, and the order of files as given."""
    folder = tmp_path / "f"
    folder.mkdir()
    lines(folder / "a.csv", "x,_cost,y,", "1,2,3,")
    lines(folder / "b.csv", "y,UNNAMED: 7,x", "30,q,10")
    got = files.read_text_csv(spark, str(folder)).select("x", "y", "_cost").orderBy("x").collect()
    assert [tuple(r) for r in got] == [("1", "3", "2"), ("10", "30", None)]
    z = lines(tmp_path / "z.csv", HEAD, "2024-01-05,P1,n,Venta,1,2,1")
    b = lines(tmp_path / "b.csv", HEAD, "2024-01-05,P1,n,Venta,1,1,0")
    assert load.run(spark, [z, b]).stock_monthly.first().stock == 0.0
    assert load.run(spark, [b, z]).stock_monthly.first().stock == 1.0
    assert "not found" in load.run(spark, [z, str(tmp_path / "none.csv")]).error


def test_legacy_files_of_two_header_orders(spark, tmp_path):
    one = lines(tmp_path / "1.csv", "Codigo;Fecha;Documento;Entrada_unid;Salida_unid;Saldo_unid", "P1;2024-01-01;VO;0;1;9")
    two = lines(tmp_path / "2.csv", "Codigo;Fecha;Documento;Salida_unid;Entrada_unid;Saldo_unid", "P2;2024-01-01;VO;5;0;9")
    moves = load.run(spark, [one, two]).movements
    assert {(r.product_id, r.in_units, r.out_units) for r in moves.collect()} == {("P1", 0.0, 1.0), ("P2", 0.0, 5.0)}


def test_codes_like_headings_are_data(spark, tmp_path):
    p = lines(tmp_path / "erp.csv", "Período: 2025;;", "Código;Descripción;Unidades", "CODIGO-7;Caja;3", "PERIODOR;Tapa;1")
    got = files.read_erp_report(spark, p, ["code", "description", "units"], "UTF-8").select("code").collect()
    assert {r.code for r in got} == {"CODIGO-7", "PERIODOR"}


def test_an_overlong_year_is_null(spark, tmp_path):
    p = lines(tmp_path / "y.csv", HEAD + ",Año", "5/1/2024,P1,n,Venta,1,2,1,99999999999", "2024-1-5,P1,n,Venta,1,1,0,2024")
    r = load.run(spark, [p]).movements.orderBy("row_seq").collect()
    assert [(x.date, x.year) for x in r] == [(dt.date(2024, 1, 5), None), (dt.date(2024, 1, 5), 2024)]


def test_snapshot_can_empty_an_organization(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "org_id string, v int")
    root = str(tmp_path / "snap")
    snapshot.save_snapshot({"t": df}, root, df, 1)
    snapshot.save_snapshot({"t": df.limit(0)}, root, df.where("org_id = 'a'"), 2)
    assert [tuple(r) for r in snapshot.load_snapshot(spark, root, "t").select("org_id", "v").collect()] == [("b", 2)]


def test_inventory_of_a_root_whose_name_repeats(spark, tmp_path):
    root = tmp_path / "data" / "x" / "data"
    (root / "o1" / "raw").mkdir(parents=True)
    lines(root / "o1" / "raw" / "a.csv", "a")
    assert [r.org_id for r in files.inventory(spark, str(root)).collect()] == ["o1"]


def test_visibility(spark):
    rows = spark.createDataFrame([("o1", 1), ("o2", 2)], "org_id string, v int")
    links = spark.createDataFrame([("u", "o1", "viewer"), ("m", "o2", "master_admin")], "user_id string, org_id string, role string")
    see = lambda u: sorted(r.v for r in N.visible_rows(rows, links, u).collect())
    assert (see("u"), see("m"), see("nobody")) == ([1], [1, 2], [])


def test_permissions(spark):
    table = {(r.role, r.permission) for r in N.permission_table(spark).collect()}
    assert ("viewer", "view_org_data") in table and ("viewer", "upload_data") not in table
    links = spark.createDataFrame([("u", "o1", "viewer"), ("m", "o2", "master_admin")], "user_id string, org_id string, role string")
    assert [r.user_id for r in N.with_permission(links, N.permission_table(spark), "upload_data").collect()] == ["m"]


def test_latest_result(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")], "k string, at int, v string")
    assert {r.k: r.v for r in snapshot.latest_per_key(df, ["k"], "at").collect()} == {"p": "b", "q": "c"}


def test_result_check(spark):
    df = spark.range(1)
    assert snapshot.is_valid_result(df, ["id"])
    assert not snapshot.is_valid_result(df.where("id > 5"), ["id"]) and not snapshot.is_valid_result(df, ["x"]) and not snapshot.is_valid_result(None, [])


def test_inventory(spark, tmp_path):
    (tmp_path / "o1" / "raw").mkdir(parents=True)
    lines(tmp_path / "o1" / "raw" / "x.csv", "a")
    got = files.inventory(spark, str(tmp_path)).select("file_key", "org_id", "file_type", "size_bytes").collect()
    assert [tuple(r) for r in got] == [("o1/raw/x.csv", "o1", "raw", 2)]
    assert F.col is not None


def test_a_table_empty_at_its_first_load(spark, tmp_path):
    df = spark.createDataFrame([("001", 1.5, "x")], "org_id string, v double, w string")
    root = str(tmp_path / "snap")
    snapshot.save_snapshot({"t": df.limit(0), "u": df}, root, df, 1)
    got = snapshot.load_snapshot(spark, root, "t")
    assert got.columns == ["org_id", "v", "w"] and got.count() == 0
    assert snapshot.load_snapshot(spark, root, "t", "none").columns == ["org_id", "v", "w"]
    assert [tuple(r) for r in snapshot.load_snapshot(spark, root, "u").collect()] == [("001", 1.5, "x")]
    with pytest.raises(ValueError, match="no stored table"):
        snapshot.load_snapshot(spark, root, "z")


def test_replaced_loads_are_removed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "org_id string, v int")
    root = tmp_path / "snap"
    for n in (1, 2, 3):
        snapshot.save_snapshot({"t": df.withColumn("v", F.col("v") * n)}, str(root), df if n < 3 else df.where("org_id = 'a'"), n)
    folders = lambda: len(list((root / "t").glob("load_id=*")))
    assert folders() == 3
    assert snapshot.expire(spark, str(root), dt.datetime(2000, 1, 1)) == [] and folders() == 3
    removed = snapshot.expire(spark, str(root), dt.datetime.now() + dt.timedelta(days=2))
    assert len(removed) == 1 and folders() == 2
    assert sorted(map(tuple, snapshot.load_snapshot(spark, str(root), "t").select("org_id", "v").collect())) == [("a", 3), ("b", 4)]


def test_results_by_key(spark, tmp_path):
    root, keys = str(tmp_path), ["project", "product_id", "model"]
    make = lambda rows, more="": spark.createDataFrame(rows, "project string, product_id string, model string, mae double" + more)
    with pytest.raises(ValueError, match="no stored results"):
        snapshot.load_results(spark, root, "backtests")
    snapshot.save_results(make([("p", "a", "m", 1.0), ("p", "b", "m", 2.0)]), root, "backtests", keys)
    snapshot.save_results(make([("p", "b", "m", 3.0, 7), ("q", "b", "m", 4.0, 8)], ", n int"), root, "backtests", keys)
    want = {("p", "a", 1.0, None), ("p", "b", 3.0, 7), ("q", "b", 4.0, 8)}
    read = lambda: {(r.project, r.product_id, r.mae, r.n) for r in snapshot.load_results(spark, root, "backtests").collect()}
    assert read() == want
    snapshot.compact_results(spark, root, "backtests")
    assert read() == want and len(list((tmp_path / "backtests" / "data").iterdir())) == 1
    snapshot.save_results(make([("p", "a", "m", 9.0)]), root, "backtests", keys)
    assert read() == (want - {("p", "a", 1.0, None)}) | {("p", "a", 9.0, None)}


def test_load_store_freshness(spark, tmp_path):
    p = lines(tmp_path / "a.csv", HEAD, "2024-01-05,P1,n,Venta,5,10,5")
    root = str(tmp_path / "store")
    assert load.run_and_store(spark, [p], root, "o1").ok
    bad = lines(tmp_path / "bad.csv", "x,y", "1,2")
    assert "bad.csv" in load.run_and_store(spark, [p, bad], root, "o1").error
    assert [tuple(r) for r in snapshot.load_snapshot(spark, root, "demand_monthly", "o1").select("product_id", "demand").collect()] == [("P1", 5.0)]
    fresh = snapshot.freshness(snapshot.manifest(spark, root)).first()
    assert (fresh.org_id, fresh.files_processed) == ("o1", 1)
