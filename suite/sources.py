"""Readers and writers. Files are written from the given tables into the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry import schema as S
from demandry.operators import build as B
from demandry.operators import clean as K
from demandry.operators import sqlapi as A
from demandry.plans import load
from demandry.session import fresh_path, materialize, sparing
from demandry.sources import files, snapshot, tpch
from demandry.sources.tpch import ledger
from suite import builders
from suite import common as C
from suite import twin as T
from suite.registry import each, query

_TEXT = ["Fecha", "Producto_id", "Producto_nombre", "Tipo_movimiento", "Cantidad", "Stock_anterior", "Stock_posterior", "Canal_venta", "Punto_venta"]
_RAW = """, raw AS (SELECT CASE WHEN ok % 211 = 0 THEN 'abc' WHEN ok % 97 = 0 THEN strftime(date, '%d/%m/%Y') ELSE strftime(date, '%Y-%m-%d') END AS "Fecha",
  CASE WHEN ok % 199 = 0 THEN '  ' WHEN ok % 53 = 0 THEN ' ' || product_id || ' ' ELSE product_id END AS "Producto_id",
  CASE WHEN ok % 53 = 0 THEN ' ' || product_name || ' ' ELSE product_name END AS "Producto_nombre",
  CASE WHEN ok % 53 = 0 THEN ' ' ELSE '' END || CASE kind WHEN 'sale' THEN 'Venta' ELSE 'Producción' END || CASE WHEN ok % 53 = 0 THEN ' ' ELSE '' END AS "Tipo_movimiento",
  CASE WHEN ok % 307 = 0 THEN '1,' || q || '.5' WHEN ok % 89 = 0 THEN q || ',0' WHEN ok % 83 = 0 THEN ' ' || q || ' ' ELSE q END AS "Cantidad",
  CAST(CAST(stock_before AS BIGINT) AS VARCHAR) AS "Stock_anterior", CAST(CAST(CASE WHEN ok % 101 = 0 THEN stock_after * 2 + 7 ELSE stock_after END AS BIGINT) AS VARCHAR) AS "Stock_posterior",
  channel AS "Canal_venta", pos AS "Punto_venta" FROM (SELECT *, CAST(CAST(qty AS BIGINT) AS VARCHAR) AS q FROM ledger))"""


def _ledger_file(spark, sf):
    """The ledger as files; what it was made from goes when they are written."""
    path = fresh_path(spark, "csv")
    with sparing(spark):
        files.write_csv(tpch.raw_ledger(spark, sf), path, compression="gzip")
    return path


@query("csv_ledger_scan", T.chain(T.LEDGER) + _RAW + " SELECT * FROM raw")
def csv_ledger_scan(spark, sf):
    path = _ledger_file(spark, sf)
    return files.require(files.read_text_csv(spark, path), S.REQUIRED).select(*_TEXT)


@query(
    "csv_clean_to_stock",
    T.chain(T.LEDGER)
    + " SELECT product_id, kind, count(*) AS n, sum(qty) AS qty, min(date) AS first_date, max(date) AS last_date FROM ledger WHERE ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0 GROUP BY product_id, kind",
)
def csv_clean_to_stock(spark, sf):
    path = _ledger_file(spark, sf)
    rows = load.run(spark, [path], keep=False).movements
    return rows.groupBy("product_id", "kind").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "csv_many_files",
    T.chain(T.LEDGER) + " SELECT year, count(*) AS n, count(CASE WHEN year < 1998 THEN channel END) AS n_channel, sum(qty) FILTER (ok % 307 <> 0) AS qty FROM ledger GROUP BY year",
)
def csv_many_files(spark, sf):
    root = fresh_path(spark, "years")
    with sparing(spark) as held:
        with sparing(spark) as sources:
            raw = materialize(tpch.raw_ledger(spark, sf), "raw")
            held.append(sources.pop())
        first, later = raw.where(F.col("Año") < "1998"), raw.where(F.col("Año") >= "1998").drop("Canal_venta")
        files.write_csv(first, f"{root}/a", compression="gzip")
        files.write_csv(later, f"{root}/b", compression="gzip")
    rows = K.typed(files.read_ledger(spark, [f"{root}/a", f"{root}/b"]))
    return rows.where(F.col("source_file").isNotNull()).groupBy("year").agg(
        F.count("*").alias("n"), F.count("channel").alias("n_channel"), F.sum("qty").alias("qty")
    )


def _legacy(spark, sf):
    rows = ledger(spark, sf, "product_id", "product_name", "date", "doc", "doc_no", "warehouse", "in_units", "out_units", "discount_pct", "qty")
    return rows.select(
        F.col("product_id").alias("Codigo"), F.col("product_name").alias("Descripcion"), F.col("date").alias("Fecha"), F.col("doc").alias("Documento"),
        F.col("doc_no").alias("Numero"), F.col("warehouse").alias("Bodega"), F.col("in_units").alias("Entrada_unid"),
        (F.col("out_units") + F.lit(0.25)).alias("Salida_unid"), (F.col("qty") / 4).alias("Saldo_unid"),
    )


@query(
    "legacy_csv",
    T.chain(T.LEDGER)
    + """ SELECT product_id AS "Codigo", doc AS "Documento", warehouse AS "Bodega", count(*) AS n, sum(in_units) AS units_in, sum(out_units + 0.25::DOUBLE) AS units_out, sum(qty / 4) AS balance
    FROM ledger GROUP BY product_id, doc, warehouse""",
)
def legacy_csv(spark, sf):
    path = fresh_path(spark, "legacy")
    files.write_csv(_legacy(spark, sf), path, sep=";", decimal=",")
    return files.read_legacy(spark, path).groupBy("Codigo", "Documento", "Bodega").agg(
        F.count("*").alias("n"), F.sum("Entrada_unid").alias("units_in"), F.sum("Salida_unid").alias("units_out"), F.sum("Saldo_unid").alias("balance")
    )


def _legacy_run(spark, sf):
    path = fresh_path(spark, "legacy")
    rows = ledger(spark, sf, "product_id", "date", "doc", "doc_no", "warehouse", "in_units", "out_units", "qty", "row_seq")
    names = {"product_id": "Codigo", "date": "Fecha", "doc": "Documento", "doc_no": "Numero", "warehouse": "Bodega", "in_units": "Entrada_unid", "out_units": "Salida_unid", "qty": "Saldo_unid"}
    # The files hold the movements in order, so those of one day have one too.
    placed = rows.repartitionByRange("date", "row_seq").sortWithinPartitions("date", "row_seq").drop("row_seq")
    files.write_csv(placed.withColumnsRenamed(names), path, sep=";", decimal=",")
    return load.run(spark, [path])


@query("legacy_to_demand", T.chain(T.LEDGER) + builders._COMPONENTS + " SELECT product_id, month, demand FROM components")
def legacy_to_demand(spark, sf):
    return _legacy_run(spark, sf).demand_monthly


@query(
    "legacy_to_stock",
    T.chain(T.LEDGER)
    + """, ends AS (SELECT *, row_number() OVER (PARTITION BY product_id, warehouse, month ORDER BY date DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS k FROM ledger)
    SELECT product_id, warehouse, month, qty AS stock FROM ends WHERE k = 1""",
)
def legacy_to_stock(spark, sf):
    return _legacy_run(spark, sf).stock_monthly.select("product_id", "warehouse", "month", "stock")


@query(
    "tenant_csv_layout",
    T.chain(T.LEDGER) + " SELECT 'ñ-' || product_id AS product, client AS company, count(*) AS n, sum(qty) AS quantity FROM ledger WHERE kind = 'sale' GROUP BY product_id, client",
)
def tenant_csv_layout(spark, sf):
    path = fresh_path(spark, "tenant")
    rows = ledger(spark, sf, "product_id", "date", "qty", "client", "kind").where(F.col("kind") == S.SALE)
    own = rows.select(F.concat(F.lit("ñ-"), F.col("product_id")).alias("SKU"), F.col("date").alias("Dia"), F.col("qty").alias("Unidades"), F.col("client").alias("Empresa"))
    files.write_csv(own, path, sep="|", encoding="ISO-8859-1")
    layout = files.CsvLayout("|", "ISO-8859-1", {"SKU": "product", "Dia": "date", "Unidades": "quantity", "Empresa": "company"})
    got = files.read_tenant_csv(spark, path, layout)
    return got.groupBy("product", "company").agg(F.count("*").alias("n"), F.sum(F.col("quantity").try_cast("double")).alias("quantity"))


@query(
    "year_tables",
    T.chain(T.LEDGER) + " SELECT year, count(*) AS n, sum(qty) AS qty, CAST(2 AS INTEGER) AS n_absent FROM ledger WHERE org_id = 'org2' AND year BETWEEN 1996 AND 1998 GROUP BY year",
)
def year_tables(spark, sf):
    root = fresh_path(spark, "bucket")
    rows = ledger(spark, sf, "org_id", "year", "product_id", "qty")
    for y in (1996, 1997, 1998):
        files.write_csv(rows.where((F.col("org_id") == "org2") & (F.col("year") == y)), f"{root}/org2/raw/data_{y}.csv")
    found, absent = files.load_years(spark, root, "org2", list(range(1994, 1999)))
    union = " UNION ALL ".join(f"SELECT year, qty FROM data_{y}" for y in found)
    return A.query(spark, f"SELECT year, count(*) AS n, sum(qty) AS qty, {len(absent)} AS n_absent FROM ({union}) GROUP BY year")


@query(
    "parquet_by_tenant",
    T.chain(T.LEDGER) + " SELECT year, product_id, sum(qty) AS qty FROM ledger WHERE org_id = 'org3' AND year = 1999 GROUP BY year, product_id",
)
def parquet_by_tenant(spark, sf):
    path = fresh_path(spark, "ledger")
    files.write_parquet(ledger(spark, sf, "org_id", "year", "product_id", "kind", "qty"), path, ["org_id", "year"])
    mine = files.read_parquet(spark, path, "org3")
    return mine.where(F.col("year") == 1999).groupBy("year", "product_id").agg(F.sum("qty").alias("qty"))


@query("parquet_export", T.chain(T.LEDGER, T.DEMAND) + " SELECT * FROM demand")
def parquet_export(spark, sf):
    path = fresh_path(spark, "processed")
    files.write_parquet(C.demand(spark, sf), path)
    return files.read_parquet_all(spark, path)


@query("csv_export", T.chain(T.LEDGER, T.DEMAND) + " SELECT * FROM demand")
def csv_export(spark, sf):
    path = fresh_path(spark, "export")
    files.write_csv(C.demand(spark, sf), path)
    got = files.read_text_csv(spark, path)
    return got.select("product_id", F.col("month").cast("date").alias("month"), F.col("demand").cast("double").alias("demand"))


@query("split_by_year", T.chain(T.LEDGER) + " SELECT year, count(*) AS n, sum(qty) AS qty, min(date) AS first_date FROM ledger GROUP BY year")
def split_by_year(spark, sf):
    path = fresh_path(spark, "by-year")
    files.split_by_year(ledger(spark, sf, "date", "product_id", "qty"), path)
    return files.read_parquet_all(spark, path).groupBy("year").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("date").alias("first_date"))


@query(
    "split_in_parts",
    T.chain(T.LEDGER)
    + """, r AS (SELECT *, row_number() OVER (ORDER BY date, ok, ln, pk, sk) - 1 AS i, count(*) OVER () AS t FROM ledger)
    SELECT CAST(CASE WHEN i < t // 3 THEN 0 WHEN i < 2 * t // 3 THEN 1 ELSE 2 END AS INTEGER) AS part, count(*) AS n, sum(qty) AS qty, min(date) AS first_date, max(date) AS last_date FROM r GROUP BY 1""",
)
def split_in_parts(spark, sf):
    path = fresh_path(spark, "parts")
    files.split_in_parts(ledger(spark, sf, "date", "qty", "row_seq"), path, 3, [F.asc("date"), F.asc("row_seq")])
    return files.read_parquet_all(spark, path).groupBy("part").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "snapshot_per_organization",
    T.chain(T.LEDGER) + " SELECT org_id, product_id, month, sum(qty) * CASE WHEN org_id = 'org1' THEN 2 ELSE 1 END AS demand FROM ledger WHERE kind = 'sale' AND org_id <> 'org2' GROUP BY org_id, product_id, month",
)
def snapshot_per_organization(spark, sf):
    root = fresh_path(spark, "snapshot")
    rows = ledger(spark, sf, "org_id", "product_id", "month", "kind", "qty").where(F.col("kind") == S.SALE)
    demand = rows.groupBy("org_id", "product_id", "month").agg(F.sum("qty").alias("demand"))
    snapshot.save_snapshot({"demand_monthly": demand}, root, demand, 6)
    # A second run for two organizations replaces only those, one of them by nothing.
    again = demand.where(F.col("org_id") == "org1").withColumn("demand", F.col("demand") * 2)
    both = demand.where(F.col("org_id").isin("org1", "org2"))
    snapshot.save_snapshot({"demand_monthly": again}, root, both, 7)
    return snapshot.load_snapshot(spark, root, "demand_monthly").select("org_id", "product_id", "month", "demand")


@query(
    "snapshot_freshness",
    T.chain(T.LEDGER) + " SELECT DISTINCT org_id, CASE WHEN org_id IN ('org1', 'org2') THEN 7 ELSE 6 END::INTEGER AS files_processed, true AS data_loaded FROM ledger",
)
def snapshot_freshness(spark, sf):
    root = fresh_path(spark, "snapshot")
    rows = ledger(spark, sf, "org_id", "product_id", "qty")
    totals = rows.groupBy("org_id", "product_id").agg(F.sum("qty").alias("qty"))
    snapshot.save_snapshot({"totals": totals}, root, totals, 6)
    snapshot.save_snapshot({"totals": totals}, root, totals.where(F.col("org_id").isin("org1", "org2")), 7)
    fresh = snapshot.freshness(snapshot.manifest(spark, root))
    return fresh.select("org_id", "files_processed", F.col("updated_at").isNotNull().alias("data_loaded"))


@query(
    "stored_backtests",
    T.chain(*T.FORECAST) + " SELECT product_id, model, mae, n, CASE WHEN length(product_id) % 2 = 0 THEN 'second' ELSE 'first' END AS run FROM scores",
    each("mae", 6),
)
def stored_backtests(spark, sf):
    """Backtests stored by product and model; a second run replaces those of some products, and the store is compacted."""
    root, keys = fresh_path(spark, "store"), ["product_id", "model"]
    scores = materialize(C.scores(spark, sf).select("product_id", "model", "mae", "n"), "scores")
    snapshot.save_results(scores.withColumn("run", F.lit("first")), root, "backtests", keys)
    some = scores.where(F.length("product_id") % 2 == 0).withColumn("run", F.lit("second"))
    snapshot.save_results(some.withColumn("mae", F.col("mae") * 2), root, "backtests", keys)
    snapshot.compact_results(spark, root, "backtests")
    snapshot.save_results(some, root, "backtests", keys)
    return snapshot.load_results(spark, root, "backtests").drop("created_at")


@query(
    "load_to_store",
    T.chain(T.LEDGER)
    + " SELECT product_id, month, abs(sum(qty)) AS demand FROM ledger WHERE kind = 'sale' AND ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0 GROUP BY product_id, month",
)
def load_to_store(spark, sf):
    """From files to the organization's stored tables, and back out of the store."""
    root = fresh_path(spark, "stored")
    with sparing(spark):
        files.write_csv(tpch.raw_ledger(spark, sf), f"{root}/in", compression="gzip")
    done = load.run_and_store(spark, [f"{root}/in"], f"{root}/store", "org0")
    assert done.ok, done.error
    return snapshot.load_snapshot(spark, f"{root}/store", "demand_monthly", "org0").select("product_id", "month", "demand")


_FIELDS = [("product_id", "string"), ("date", "date"), ("kind", "string"), ("qty", "double"), ("doc_no", "string")]


@query(
    "table_description",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows FROM lineitem" for c, t in _FIELDS),
)
def table_description(spark, sf):
    A.register({"movements_described": ledger(spark, sf, *[c for c, _ in _FIELDS])})
    assert "movements_described" in A.list_tables(spark)
    return A.describe_table(spark.table("movements_described")).select("column", "type", "n_rows")


@query(
    "file_inventory",
    T.chain(T.LEDGER) + " SELECT DISTINCT org_id, t AS file_type, 1::BIGINT AS n_files, true AS has_bytes FROM ledger, (VALUES ('raw'), ('processed')) v(t)",
)
def file_inventory(spark, sf):
    root = fresh_path(spark, "store")
    rows = ledger(spark, sf, "org_id", "year", "product_id", "qty")
    for i in range(5):
        mine = rows.where(F.col("org_id") == f"org{i}")
        # One file each; the table is read and cut in parallel, and only the organization's rows meet.
        files.write_csv(mine.repartition(1), f"{root}/org{i}/raw")
        files.write_parquet(mine.repartition(1), f"{root}/org{i}/processed")
    found = files.inventory(spark, root).where(F.col("file_key").rlike("part-[^/]*(csv|parquet)$"))
    totals = files.inventory_totals(found)
    return totals.select("org_id", "file_type", "n_files", (F.col("total_bytes") > 0).alias("has_bytes"))


@query(
    "result_validation",
    T.chain(T.LEDGER, T.DEMAND)
    + """ SELECT 'complete' AS result, true AS valid, count(*) AS n_rows FROM demand UNION ALL SELECT 'without_column', false, count(*) FROM demand
    UNION ALL SELECT 'without_rows', false, count(*) FROM demand WHERE demand < 0""",
)
def result_validation(spark, sf):
    demand = C.demand(spark, sf)
    checks = {
        "complete": (demand, ["product_id", "month", "demand"]),
        "without_column": (demand.drop("demand"), ["product_id", "month", "demand"]),
        "without_rows": (demand.where("demand < 0"), ["product_id", "month", "demand"]),
    }
    out = None
    for name, (df, cols) in checks.items():
        ok = snapshot.is_valid_result(df, cols)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("result"), F.lit(ok).alias("valid"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "erp_report",
    T.chain(T.LEDGER) + " SELECT product_id AS code, product_name AS description, count(*) AS n, sum(in_units) AS units_in, sum(out_units) AS units_out FROM ledger GROUP BY product_id, product_name",
)
def erp_report(spark, sf):
    path = fresh_path(spark, "erp")
    rows = ledger(spark, sf, "product_id", "product_name", "date", "in_units", "out_units")
    line = F.concat_ws(";", F.concat(F.lit("'"), F.col("product_id"), F.lit("'")), "product_name", F.col("date").cast("string"), F.col("in_units").cast("string"), F.col("out_units").cast("string"))
    body = rows.select(line.alias("value"))
    # A period line and a header with repeated names above the rows of each year's report.
    years = ledger(spark, sf, "year").distinct()
    head = years.select(F.explode(F.array(F.concat(F.lit("Período: "), F.col("year").cast("string"), F.lit(";;;;")), F.lit("Código;Descripción;Fecha;Unidades;Unidades"))).alias("value"))
    head.unionByName(body).write.option("encoding", "ISO-8859-1").text(path)
    got = files.read_erp_report(spark, path, ["code", "description", "date", "units_in", "units_out"], "UTF-8")
    return got.groupBy("code", "description").agg(
        F.count("*").alias("n"), F.sum(F.col("units_in").try_cast("double")).alias("units_in"), F.sum(F.col("units_out").try_cast("double")).alias("units_out")
    )


def _two_orders(rows, root):
    """One folder whose files differ in the order of their columns, as two appends."""
    names = rows.columns
    for part, cols in ((rows.where("even"), names), (rows.where("NOT even"), names[::-1])):
        part.select(*[c for c in cols if c != "even"]).write.mode("append").option("header", True).csv(root)


@query(
    "csv_header_orders",
    T.chain(T.LEDGER)
    + " SELECT product_id, kind, count(*) AS n, sum(qty) AS qty, sum(CASE WHEN ok % 2 = 0 THEN 2 * qty ELSE 3 * qty END) AS mixed, CAST(sum(ok) AS BIGINT) AS cost FROM ledger GROUP BY product_id, kind",
)
def csv_header_orders(spark, sf):
    """Columns go by name, also within a folder; a column whose name begins like a blank one's is kept."""
    path = fresh_path(spark, "orders")
    rows = ledger(spark, sf, "product_id", "product_name", "date", "kind", "qty", "row_seq")
    named = rows.select(
        F.col("date").cast("string").alias("Fecha"), F.col("product_id").alias("Producto_id"), F.col("product_name").alias("Producto_nombre"),
        F.when(F.col("kind") == S.SALE, S.SALE_LABEL).otherwise(S.PRODUCTION_LABEL).alias("Tipo_movimiento"), F.col("qty").alias("Cantidad"),
        (3 * F.col("qty")).alias("Stock_anterior"), (2 * F.col("qty")).alias("Stock_posterior"), F.col("row_seq.l_orderkey").alias("_cost"),
        (F.col("row_seq.l_orderkey") % 2 == 0).alias("even"),
    )
    _two_orders(named, path)
    got = K.typed(files.read_ledger(spark, [path]))
    mixed = F.when(F.col("_cost").cast("long") % 2 == 0, F.col("stock_after")).otherwise(F.col("stock_before"))
    return got.groupBy("product_id", "kind").agg(
        F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum(mixed).alias("mixed"), F.sum(F.col("_cost").cast("long")).alias("cost")
    )


@query(
    "legacy_header_orders",
    T.chain(T.LEDGER) + " SELECT product_id, month, sum(in_units) AS units_in, sum(out_units) AS units_out, count(*) AS n FROM ledger GROUP BY product_id, month",
)
def legacy_header_orders(spark, sf):
    path = fresh_path(spark, "legacy")
    rows = ledger(spark, sf, "product_id", "date", "doc", "in_units", "out_units", "qty")
    names = {"product_id": "Codigo", "date": "Fecha", "doc": "Documento", "in_units": "Entrada_unid", "out_units": "Salida_unid", "qty": "Saldo_unid"}
    old = rows.withColumnsRenamed(names)
    files.write_csv(old.where(F.day("Fecha") <= 15), f"{path}/a", sep=";", decimal=",")
    files.write_csv(old.where(F.day("Fecha") > 15).select(*old.columns[::-1]), f"{path}/b", sep=";", decimal=",")
    moves = load.run(spark, [f"{path}/b", f"{path}/a"]).movements
    return moves.groupBy("product_id", "month").agg(F.sum("in_units").alias("units_in"), F.sum("out_units").alias("units_out"), F.count("*").alias("n"))


@query(
    "unpadded_dates",
    T.chain(T.LEDGER) + " SELECT date, year, CAST(NULL AS INTEGER) AS long_year, count(*) AS n FROM ledger GROUP BY date, year",
)
def unpadded_dates(spark, sf):
    """Days and months without leading zeros, in both formats, and years too long to be any."""
    path = fresh_path(spark, "dates")
    rows = ledger(spark, sf, "product_id", "date", "year", "qty", "row_seq")
    day, month, year = F.day("date"), F.month("date"), F.col("year")
    written = F.when(F.col("row_seq.l_orderkey") % 2 == 0, F.concat_ws("/", day, month, year)).otherwise(F.concat_ws("-", year, month, day))
    raw = rows.select(
        written.alias("Fecha"), F.col("product_id").alias("Producto_id"), F.lit("n").alias("Producto_nombre"), F.lit(S.SALE_LABEL).alias("Tipo_movimiento"),
        F.col("qty").alias("Cantidad"), F.lit("").alias("Stock_anterior"), F.lit("").alias("Stock_posterior"), F.concat("year", F.lit("0000000")).alias("Año"),
    )
    files.write_csv(raw, path)
    rows = load.run(spark, [path], keep=False).movements
    return rows.groupBy("date", F.year("date").alias("year"), F.col("year").alias("long_year")).agg(F.count("*").alias("n"))


@query(
    "ties_in_given_order",
    T.chain(T.LEDGER)
    + """, ends AS (SELECT *, row_number() OVER (PARTITION BY product_id, month ORDER BY date DESC, ok % 2 DESC, ok DESC, ln DESC, pk DESC, sk DESC) AS k FROM ledger)
    SELECT product_id, month, qty AS stock FROM ends WHERE k = 1""",
)
def ties_in_given_order(spark, sf):
    """Of movements on one day, the last one in the order of the files as given, whatever their names, is the last."""
    path = fresh_path(spark, "ties")
    rows = ledger(spark, sf, "product_id", "date", "qty", "row_seq")
    raw = rows.select(
        F.col("date").cast("string").alias("Fecha"), F.col("product_id").alias("Producto_id"), F.lit("n").alias("Producto_nombre"), F.lit("Otro").alias("Tipo_movimiento"),
        F.col("qty").alias("Cantidad"), F.lit("").alias("Stock_anterior"), F.col("qty").alias("Stock_posterior"), "row_seq",
    )
    # Given as z, then b; each holds its rows in order.
    for name, rest in (("z", 0), ("b", 1)):
        mine = raw.where(F.col("row_seq.l_orderkey") % 2 == rest).repartitionByRange("Fecha", "row_seq").sortWithinPartitions("Fecha", "row_seq")
        files.write_csv(mine.drop("row_seq"), f"{path}/{name}")
    return load.run(spark, [f"{path}/z", f"{path}/b"], keep=False).stock_monthly.select("product_id", "month", "stock")


@query(
    "warehouse_balance_over_files",
    T.chain(T.LEDGER)
    + """ SELECT product_id, warehouse, ok || '-' || ln || '-' || pk || '-' || sk AS row,
      sum(in_units - out_units) OVER (PARTITION BY product_id, warehouse ORDER BY date, ok % 2, ok, ln, pk, sk ROWS UNBOUNDED PRECEDING) AS balance FROM ledger""",
)
def warehouse_balance_over_files(spark, sf):
    """Movements of one day in two files count file by file as the files were given, not by their places in the files."""
    path = fresh_path(spark, "balance")
    rows = ledger(spark, sf, "product_id", "date", "doc", "doc_no", "warehouse", "in_units", "out_units", "row_seq")
    seq = F.col("row_seq")
    raw = rows.select(
        F.col("product_id").alias("Codigo"), F.concat_ws("-", *[seq[c] for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("Descripcion"),
        F.col("date").alias("Fecha"), F.col("doc").alias("Documento"), F.col("doc_no").alias("Numero"), F.col("warehouse").alias("Bodega"),
        F.col("in_units").alias("Entrada_unid"), F.col("out_units").alias("Salida_unid"), F.lit(0.0).alias("Saldo_unid"), "row_seq",
    )
    for name, rest in (("z", 0), ("b", 1)):
        mine = raw.where(F.col("row_seq.l_orderkey") % 2 == rest).repartitionByRange("Fecha", "row_seq").sortWithinPartitions("Fecha", "row_seq")
        files.write_csv(mine.drop("row_seq"), f"{path}/{name}", sep=";", decimal=",")
    moves = load.run(spark, [f"{path}/z", f"{path}/b"], keep=False).movements
    return B.warehouse_balance(moves).select("product_id", "warehouse", F.col("product_name").alias("row"), "balance")
