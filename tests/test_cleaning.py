from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import to_number
from demandry.operators import build as B
from demandry.operators import clean as K
from demandry.operators import convert as V
from demandry.sources.files import MissingColumns

FIELDS = ["Fecha", "Producto_id", "Producto_nombre", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior"]


def raw(spark, rows):
    return spark.createDataFrame(rows, S.text_schema(FIELDS))


def row(fecha="2024-01-05", pid="P1", kind="Venta", qty="5", before="10", after="5"):
    return (fecha, pid, "name", kind, qty, before, after)


@pytest.mark.parametrize(
    ("given", "kept"),
    [
        (row(), True),
        (row(fecha="05/01/2024"), True),
        (row(fecha="abc"), False),
        (row(qty="1 200", before="1200", after="0"), True),
        (row(qty="12,5", before="12,5", after="0"), True),
        (row(qty="1,234.5"), False),
        (row(pid="  "), False),
        (row(pid=None), False),
        (row(after="3"), False),
        (row(kind="Producción", after="15"), True),
        (row(kind=" Venta "), True),
        (row(after=None), True),
        (row(kind="Ajuste", after="77"), True),
        # A stated balance of -1: exact is undefined and stays, anything else is infinitely off.
        (row(qty="11", after="-1"), True),
        (row(qty="5", after="-1"), False),
        # One unit off in a hundred is the tolerance itself.
        (row(qty="1", before="101", after="99"), True),
    ],
)
def test_rules(spark, given, kept):
    assert K.clean(raw(spark, [given])).count() == int(kept)


def test_values(spark):
    out = K.clean(raw(spark, [row(fecha=" 05/01/2024 ", pid=" P9 ", qty="1 2,5", before="12,5", after="0")])).first()
    assert (out.date, out.product_id, out.kind, out.qty) == (dt.date(2024, 1, 5), "P9", S.SALE, 12.5)


def test_numbers(spark):
    texts = ["1 200", "12,5", "1,234.5", "1d", "2F", "0x1p3", "NaN", "inf", "Infinity", "1e3", "-.5", "+7", "", None, "--1", "5."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", to_number("t").alias("v")).orderBy("i").collect()]
    assert got == [1200.0, 12.5, None, None, None, None, None, None, None, 1000.0, -0.5, 7.0, None, None, None, 5.0]


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumns, match="Cantidad"):
        K.clean(raw(spark, [row()]).drop("Cantidad"))


def test_cleaning_typed_rows_again_changes_nothing(spark):
    once = K.complete_rows(K.coherent(K.typed(raw(spark, [row(), row(after="3"), row(fecha="x"), row(kind="Producción", after="15")]))))
    again = K.complete_rows(K.coherent(once))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_summary(spark):
    t = K.typed(raw(spark, [row(), row(after="3"), row(pid="P2", kind="Producción", after="15"), row(fecha="x")]))
    s = K.cleaning_summary(t).first()
    assert (s.n_read, s.n_kept, s.kept_pct, s.n_products, s.n_sales, s.n_productions) == (4, 2, 50.0, 2, 1, 1)


def guides(spark, rows):
    return spark.createDataFrame(
        [(d, n, "P", dt.date(2024, 1, 1), i, o, k) for k, (d, n, i, o) in enumerate(rows)],
        "doc string, doc_no string, product_id string, month date, in_units double, out_units double, row_seq int",
    )


def test_guides(spark):
    df = guides(spark, [("GU", "1", 0.0, 6.0), ("GU", "1", 0.0, 4.0), ("GU", "2", 0.0, 6.0), ("GU", "2", 10.0, 0.0), ("GU", "3", 0.0, 0.0), ("VO", "1", 0.0, 9.0)])
    got = {r.row_seq: (r.guide_type, r.external_units) for r in B.reconcile_guides(df).collect()}
    ext, tra = S.GUIDE_EXTERNAL, S.GUIDE_TRANSFER
    assert got == {0: (ext, 6.0), 1: (ext, 4.0), 2: (tra, 0.0), 3: (tra, 0.0), 4: (tra, 0.0), 5: (S.GUIDE_NONE, 0.0)}
    whole = B.reconcile_guides(df, prorate=False).where("doc_no = '1' AND doc = 'GU'").select("external_units").collect()
    assert [r[0] for r in whole] == [10.0, 10.0]


def test_prorated_units_add_up_to_the_group(spark):
    df = guides(spark, [("GU", str(k % 5), 0.0, float(k % 7)) for k in range(200)])
    sums = B.reconcile_guides(df).groupBy("doc_no").agg(F.sum("external_units").alias("e"), F.sum("out_units").alias("o"), F.first("guide_type").alias("g"))
    assert all(r.e == r.o for r in sums.collect() if r.g == S.GUIDE_EXTERNAL)


def test_versions():
    v4 = V.detect_version(S.LEDGER_COLUMNS)
    assert (v4["version"], v4["confidence"], v4["missing_columns"]) == ("v4", 0.95, [])
    assert V.detect_version(S.LEGACY_COLUMNS)["version"] == "legacy"
    assert V.detect_version(["Fecha", "Mes"])["confidence"] == 0.5
    assert V.detect_version([])["version"] == "unknown"
    assert V.common_format([S.LEDGER_COLUMNS, S.LEDGER_COLUMNS]) == "v4"
    with pytest.raises(ValueError, match="mixed"):
        V.common_format([S.LEDGER_COLUMNS, S.LEGACY_COLUMNS])
    with pytest.raises(ValueError, match="unknown"):
        V.detect_format(["a", "b"])


def test_stock_measure_is_found_by_order():
    assert V.stock_measure(["Stock_final", "Saldo_unid"]) == "Saldo_unid"
    assert V.stock_measure(["x"]) is None


def test_last_movement_of_a_day_wins(spark):
    rows = [("P", dt.date(2024, 1, 31), 1, 5.0), ("P", dt.date(2024, 1, 31), 2, 7.0), ("P", dt.date(2024, 1, 2), 9, 1.0), ("Q", dt.date(2024, 1, 3), 1, None)]
    df = spark.createDataFrame(rows, "product_id string, date date, row_seq int, stock_after double")
    got = {r.product_id: r.stock for r in B.stock_monthly(df, order=["date", "row_seq"]).collect()}
    assert got == {"P": 7.0, "Q": 0.0}


def test_catalogue_subset_prefers_matches(spark):
    rows = [(f"P{i}", "CAJA" if i in (7, 9) else "otro", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "product_id string, product_name string, qty double")
    kept = sorted(r.product_id for r in K.catalogue_subset(df, "caja|tablero", 4).collect())
    assert kept == ["P0", "P1", "P7", "P9"]
