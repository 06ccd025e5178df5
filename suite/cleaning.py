"""Typing, rejection, labels and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry import schema as S
from demandry.operators import build as B
from demandry.operators import clean as K
from demandry.operators import convert as V
from demandry.operators import quality as Q
from demandry.sources import tpch
from demandry.sources.tpch import balanced_ledger, ledger
from suite import common as C
from suite import twin as T
from suite.registry import each, query

# What the dirty rows become: see the ledger adapter for the multiples.
_DIRTY = """, typed AS (
  SELECT CASE WHEN ok % 211 = 0 THEN NULL ELSE date END AS date, CASE WHEN ok % 199 = 0 THEN '' ELSE product_id END AS product_id, product_name, kind,
    CASE WHEN ok % 307 = 0 THEN NULL ELSE qty END AS qty, stock_before,
    CASE WHEN ok % 101 = 0 THEN stock_after * 2 + 7 ELSE stock_after END AS stock_after, unit_cost, discount_pct FROM ledger),
marked AS (
  SELECT *, CASE WHEN abs((CASE WHEN kind = 'sale' THEN stock_before - qty ELSE stock_before + qty END - stock_after) / abs(stock_after + 1)) > 0.01 THEN 'balance'
    WHEN date IS NULL THEN 'date' WHEN product_id = '' THEN 'product' WHEN qty IS NULL THEN 'quantity' END AS reason FROM typed)"""


def _typed(spark, sf):
    return K.typed(tpch.raw_ledger(spark, sf))


@query(
    "typed_values",
    T.chain(T.LEDGER) + _DIRTY + " SELECT date, product_id, kind, qty, stock_before, stock_after, discount_pct, count(*) AS n FROM typed GROUP BY ALL",
    each("discount_pct", 6),
)
def typed_values(spark, sf):
    return _typed(spark, sf).groupBy("date", "product_id", "kind", "qty", "stock_before", "stock_after", "discount_pct").agg(F.count("*").alias("n"))


@query(
    "clean_movements",
    T.chain(T.LEDGER) + _DIRTY + " SELECT date, product_id, product_name, kind, qty, stock_before, stock_after, unit_cost FROM marked WHERE reason IS NULL",
)
def clean_movements(spark, sf):
    return K.clean(tpch.raw_ledger(spark, sf)).select("date", "product_id", "product_name", "kind", "qty", "stock_before", "stock_after", "unit_cost")


@query("rejections", T.chain(T.LEDGER) + _DIRTY + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM marked GROUP BY 1")
def rejections(spark, sf):
    return _typed(spark, sf).groupBy(F.coalesce(K.rejection_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "cleaning_summary",
    T.chain(T.LEDGER)
    + _DIRTY
    + """ SELECT count(*) AS n_read, count(*) FILTER (reason IS NULL) AS n_kept, 100.0::DOUBLE * count(*) FILTER (reason IS NULL) / count(*) AS kept_pct,
    min(date) FILTER (reason IS NULL) AS first_date, max(date) FILTER (reason IS NULL) AS last_date, count(DISTINCT product_id) FILTER (reason IS NULL) AS n_products,
    count(*) FILTER (reason IS NULL AND kind = 'sale') AS n_sales, count(*) FILTER (reason IS NULL AND kind = 'production') AS n_productions FROM marked""",
    each("kept_pct", 6),
)
def cleaning_summary(spark, sf):
    return K.cleaning_summary(_typed(spark, sf))


@query(
    "coherence_report",
    T.chain(T.LEDGER)
    + _DIRTY
    + """ SELECT kind, count(*) AS n_rows, count(*) FILTER (e = stock_after) AS n_ok, count(*) FILTER (e <> stock_after) AS n_violations,
    100.0::DOUBLE * count(*) FILTER (e = stock_after) / count(*) AS ok_pct
    FROM (SELECT *, CASE WHEN kind = 'sale' THEN stock_before - qty ELSE stock_before + qty END AS e FROM typed) GROUP BY kind""",
    each("ok_pct", 6),
)
def coherence_report(spark, sf):
    return K.coherence_report(_typed(spark, sf))


@query(
    "coherence_examples",
    T.chain(T.LEDGER)
    + _DIRTY
    + """ SELECT product_id, date, kind, qty, stock_before, e AS expected, stock_after
    FROM (SELECT *, CASE WHEN kind = 'sale' THEN stock_before - qty ELSE stock_before + qty END AS e FROM typed) WHERE e <> stock_after
    ORDER BY date NULLS FIRST, product_id, qty, stock_before LIMIT 3""",
)
def coherence_examples(spark, sf):
    return K.coherence_examples(_typed(spark, sf), [F.col("date"), F.col("product_id"), F.col("qty"), F.col("stock_before")])


@query(
    "plain_codes",
    T.chain(T.LEDGER) + " SELECT code, count(*) AS n, sum(qty) AS qty FROM (SELECT product_type || CASE WHEN ln = 1 THEN '''' WHEN ln = 2 THEN '(' WHEN ln = 3 THEN ')' ELSE '' END AS code, qty FROM ledger) WHERE NOT regexp_matches(code, '[''()]') GROUP BY code",
)
def plain_codes(spark, sf):
    rows = ledger(spark, sf, "product_type", "qty", "row_seq")
    ln = F.col("row_seq.l_linenumber")
    mark = F.when(ln == 1, "'").when(ln == 2, "(").when(ln == 3, ")").otherwise("")
    rows = rows.select(F.concat("product_type", mark).alias("code"), "qty")
    return K.plain_codes(rows, "code").groupBy("code").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(
    "catalogue_subset",
    T.chain(T.LEDGER)
    + """, chosen AS (SELECT product_id, max(regexp_matches(product_name, '(?i)gizmo|gear')) AS rel FROM ledger GROUP BY product_id ORDER BY rel DESC, product_id LIMIT 20)
    SELECT product_id, kind, count(*) AS n, sum(qty) AS qty FROM ledger WHERE product_id IN (SELECT product_id FROM chosen) GROUP BY product_id, kind""",
)
def catalogue_subset(spark, sf):
    rows = ledger(spark, sf, "product_id", "product_name", "kind", "qty")
    return K.catalogue_subset(rows, "gizmo|gear", 20).groupBy("product_id", "kind").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(
    "line_value",
    T.chain(T.LEDGER)
    + """ SELECT product_id, count(*) AS n, sum(units) AS units, sum(base_price * units * (1 - d / 100)) AS line_value FROM (
    SELECT product_id, CAST(greatest(CAST(trunc(CASE WHEN out_units > 0 THEN out_units ELSE in_units END) AS BIGINT), 1) AS DOUBLE) AS units,
      coalesce(unit_price, unit_cost) AS base_price, least(greatest(coalesce(10 * discount_pct - 20, 0), 0), 50) AS d FROM ledger) GROUP BY product_id""",
    each("line_value", 3),
)
def line_value(spark, sf):
    rows = ledger(spark, sf, "product_id", "in_units", "out_units", "unit_price", "unit_cost", "discount_pct")
    rows = rows.withColumns({"base_price": F.coalesce("unit_price", "unit_cost"), "discount_pct": F.col("discount_pct") * 10 - 20})
    out = K.line_value(rows)
    return out.groupBy("product_id").agg(F.count("*").alias("n"), F.sum(F.col("units").cast("double")).alias("units"), F.sum("line_value").alias("line_value"))


@query(
    "anomaly_profile",
    T.chain(T.LEDGER)
    + """, v AS (SELECT unnest(['unit_price', 'unit_cost', 'total_value', 'qty']) AS "column", unnest([unit_price, unit_cost, total_value, qty]) AS value FROM ledger),
    s AS (SELECT "column", avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
      quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS low,
      quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS high FROM v WHERE value IS NOT NULL GROUP BY "column")
    SELECT s.*, o.n AS n_outliers, 100.0::DOUBLE * o.n / (SELECT count(*) FROM ledger) AS outlier_pct FROM s JOIN (
      SELECT v."column", count(*) FILTER (value < low OR value > high) AS n FROM v JOIN s ON s."column" = v."column" GROUP BY v."column") o ON o."column" = s."column" """,
    each("mean median std min max low high outlier_pct", 5),
)
def anomaly_profile(spark, sf):
    return Q.anomaly_profile(ledger(spark, sf, "unit_price", "unit_cost", "total_value", "qty"), ["unit_price", "unit_cost", "total_value", "qty"])


@query(
    "absurd_values",
    T.chain(T.LEDGER)
    + """ SELECT 'unit_price' AS "column", count(*) FILTER (unit_price > 100000) AS n_absurd, max(unit_price) AS max FROM ledger
    UNION ALL SELECT 'unit_cost', count(*) FILTER (unit_cost > 100000), max(unit_cost) FROM ledger
    UNION ALL SELECT 'total_value', count(*) FILTER (total_value > 100000), max(total_value) FROM ledger""",
    each("max", 6),
)
def absurd_values(spark, sf):
    cols = ["unit_price", "unit_cost", "total_value"]
    return Q.absurd_values(ledger(spark, sf, *cols), cols)


_LABELS = """CASE WHEN kind = 'production' THEN 'Entrada por Producción' WHEN doc = 'VO' THEN 'Venta Tienda Sin Doc' WHEN doc = 'CO' THEN 'Salida por Consumo' ELSE 'Guia de remision - R' END"""
_STORES = """CASE sk % 4 WHEN 0 THEN 'Almacen Central' WHEN 1 THEN 'Almacen Punto de Ventas 1' WHEN 2 THEN 'Almacen Punto de Venta 2' ELSE 'Almacen Punto de Venta 3' END"""


@query(
    "labels_from_codes",
    T.chain(T.LEDGER)
    + f""", l AS (SELECT {_LABELS} AS label, {_STORES} AS store, qty FROM ledger)
    SELECT label, store, CASE label WHEN 'Salida por Consumo' THEN 'consumo_interno' WHEN 'Venta Tienda Sin Doc' THEN 'mostrador' WHEN 'Guia de remision - R' THEN 'distribuído' END AS channel,
    CASE WHEN label LIKE '%Entrada%' THEN NULL WHEN label LIKE '%Guia de remision%' THEN 'Online' ELSE 'Tienda Física' END AS channel_by_text,
    CASE store WHEN 'Almacen Central' THEN 'Centro' WHEN 'Almacen Punto de Ventas 1' THEN 'Norte' WHEN 'Almacen Punto de Venta 2' THEN 'Sur' ELSE 'Este' END AS region,
    CASE store WHEN 'Almacen Central' THEN 'Lima' END AS department, count(*) AS n, sum(qty) AS qty FROM l GROUP BY ALL""",
)
def labels_from_codes(spark, sf):
    rows = ledger(spark, sf, "kind", "doc", "qty", "row_seq")
    label = (
        F.when(F.col("kind") == S.PRODUCTION, "Entrada por Producción").when(F.col("doc") == "VO", "Venta Tienda Sin Doc")
        .when(F.col("doc") == "CO", "Salida por Consumo").otherwise("Guia de remision - R")
    )
    sk = F.col("row_seq.l_suppkey") % 4
    store = F.when(sk == 0, "Almacen Central").when(sk == 1, "Almacen Punto de Ventas 1").when(sk == 2, "Almacen Punto de Venta 2").otherwise("Almacen Punto de Venta 3")
    rows = rows.select(label.alias("label"), store.alias("store"), "qty")
    rows = rows.withColumns(
        {"channel": V.label("label", S.DOCUMENT_CHANNEL), "channel_by_text": V.channel_by_text("label"), "region": V.label("store", S.WAREHOUSE_REGION),
         "department": V.department_by_text("store")}
    )
    return rows.groupBy("label", "store", "channel", "channel_by_text", "region", "department").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


_TYPES = """CASE p_type WHEN 'ECONOMY' THEN 'Caja de pase ' WHEN 'SMALL' THEN 'BANDEJA ' WHEN 'MEDIUM' THEN 'tubo conduit ' WHEN 'PROMO' THEN 'Tapa ' WHEN 'LARGE' THEN 'Union tee ' ELSE '' END || p_name"""


@query(
    "product_types",
    f"""SELECT type, count(*) AS n FROM (SELECT CASE WHEN d LIKE '%caja%' THEN 'caja' WHEN d LIKE '%bandeja%' THEN 'bandeja' WHEN d LIKE '%tuberia%' OR d LIKE '%conduit%' THEN 'tuberia'
    WHEN d LIKE '%gabinete%' THEN 'gabinete' WHEN d LIKE '%tapa%' THEN 'tapa' WHEN d LIKE '%curva%' OR d LIKE '%union%' OR d LIKE '%tee%' THEN 'accesorios' ELSE 'otros' END AS type
    FROM (SELECT lower({_TYPES}) AS d FROM part)) GROUP BY type""",
)
def product_types(spark, sf):
    return _described(spark, sf).groupBy(V.product_type("name").alias("type")).agg(F.count("*").alias("n"))


def _described(spark, sf):
    t = F.col("p_type")
    words = (
        F.when(t == "ECONOMY", "Caja de pase ").when(t == "SMALL", "BANDEJA ").when(t == "MEDIUM", "tubo conduit ").when(t == "PROMO", "Tapa ")
        .when(t == "LARGE", "Union tee ").otherwise("")
    )
    return tpch.table(spark, sf, "part").select("p_partkey", F.concat(words, F.col("p_name")).alias("name"), "p_size", "p_retailprice")


@query(
    "price_band_violations",
    f"""WITH t AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'caja' WHEN 'SMALL' THEN 'bandeja' WHEN 'MEDIUM' THEN 'tuberia' WHEN 'PROMO' THEN 'tapa' WHEN 'LARGE' THEN 'accesorios' ELSE 'otros' END AS type,
      p_size / 10.0::DOUBLE AS cost, p_retailprice / 200 AS price FROM part),
    b AS (SELECT * FROM (VALUES ('caja', 1.5, 3.5, 4.0, 8.0), ('bandeja', 2.0, 4.0, 5.0, 9.0), ('tuberia', 1.0, 2.5, 2.5, 7.0), ('tapa', 0.8, 2.0, 2.0, 5.0), ('accesorios', 0.6, 1.5, 1.5, 4.5), ('otros', 1.5, 3.0, 3.5, 8.5)) v(type, c0, c1, p0, p1))
    SELECT type, count(*) AS n, count(*) FILTER (cost < CAST(c0 AS DOUBLE) OR cost > CAST(c1 AS DOUBLE)) AS n_cost_outside,
      count(*) FILTER (price < greatest(CAST(p0 AS DOUBLE), cost * 1.3::DOUBLE) OR price > CAST(p1 AS DOUBLE)) AS n_price_outside FROM t JOIN b USING (type) GROUP BY type""",
)
def price_band_violations(spark, sf):
    rows = _described(spark, sf).select(V.product_type("name").alias("type"), (F.col("p_size") / 10.0).alias("cost"), (F.col("p_retailprice") / 200).alias("price"))
    out = V.price_bands(rows, S.PRICE_BANDS, kind="type", cost="cost", price="price")
    return out.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("cost_outside").alias("n_cost_outside"), F.count_if("price_outside").alias("n_price_outside")
    )


@query(
    "discount_tiers",
    T.chain(T.LEDGER)
    + " SELECT CASE WHEN l_discount >= 0.06 THEN 'alto' WHEN l_discount >= 0.03 THEN 'medio' ELSE 'bajo' END AS tier, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1",
)
def discount_tiers(spark, sf):
    rows = ledger(spark, sf, "kind", "discount_pct", "qty").where(F.col("kind") == S.SALE).withColumn("d", F.round("discount_pct", 6))
    return rows.groupBy(V.discount_tier("d").alias("tier")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def _v4_demand(spark, sf):
    return C.demand(spark, sf).select(
        F.concat(F.lit(" "), F.col("product_id")).alias("Producto_id"),
        F.when(F.year("month") != 1999, F.year("month")).cast("string").alias("Año"),
        F.when(F.month("month") == 12, 14).when(F.month("month") != 7, F.month("month")).cast("string").alias("Mes"),
        F.col("demand").alias("Cantidad_total"),
    )


_MONTH_FIX = "make_date(CASE WHEN year(month) = 1999 THEN 2024 ELSE year(month) END, CASE WHEN month(month) = 7 THEN 1 ELSE month(month) END, 1)"


@query("demand_to_legacy", T.chain(T.LEDGER, T.DEMAND) + f' SELECT product_id AS "Codigo", {_MONTH_FIX} AS "Mes", demand AS "Demanda_Unid" FROM demand')
def demand_to_legacy(spark, sf):
    return V.demand_to_legacy(_v4_demand(spark, sf))


@query(
    "movements_to_legacy",
    T.chain(T.LEDGER)
    + """ SELECT product_id AS "Codigo", CASE kind WHEN 'sale' THEN 'Venta' ELSE 'Producción' END AS "Documento", '' AS "Numero", '' AS "Bodega",
    count(*) AS n, sum(qty) AS "Cantidad_reg", sum(CASE WHEN kind = 'sale' THEN abs(qty) ELSE 0 END) AS "Salida_unid" FROM ledger GROUP BY product_id, kind""",
)
def movements_to_legacy(spark, sf):
    rows = ledger(spark, sf, "product_id", "kind", "qty").select(
        F.concat(F.col("product_id"), F.lit(" ")).alias("Producto_id"),
        F.when(F.col("kind") == S.SALE, S.SALE_LABEL).otherwise(S.PRODUCTION_LABEL).alias("Tipo_movimiento"),
        F.col("qty").alias("Cantidad"),
    )
    return V.movements_to_legacy(rows).groupBy("Codigo", "Documento", "Numero", "Bodega").agg(
        F.count("*").alias("n"), F.sum("Cantidad_reg").alias("Cantidad_reg"), F.sum("Salida_unid").alias("Salida_unid")
    )


@query("stock_to_legacy", T.chain(T.LEDGER, T.STOCK) + ' SELECT product_id AS "Codigo", month AS "Mes", stock AS "Saldo_unid" FROM stock')
def stock_to_legacy(spark, sf):
    v4 = C.stock(spark, sf).select(
        F.col("product_id").alias("Producto_id"), F.year("month").alias("Año"), F.month("month").alias("Mes"), F.col("stock").alias("Stock_final")
    )
    return V.stock_to_legacy(v4)


@query(
    "ledger_transform",
    T.chain(T.LEDGER)
    + """ SELECT date, month, product_id, kind, qty, CASE WHEN kind = 'sale' THEN abs(qty) ELSE 0 END AS out_units, CASE WHEN kind = 'production' THEN abs(qty) ELSE 0 END AS in_units,
    stock_before, stock_after, channel FROM ledger""",
)
def ledger_transform(spark, sf):
    out = V.ledger_transform(balanced_ledger(spark, sf, "channel").drop("month", "row_block", "row_seq"))
    return out.select("date", "month", "product_id", "kind", "qty", "out_units", "in_units", "stock_before", "stock_after", "channel")


@query(
    "detected_versions",
    T.chain(T.LEDGER, T.STOCK)
    + """ SELECT 'ledger' AS "table", 'v4' AS version, 0.95::DOUBLE AS confidence, '' AS missing, 'Producto_id' AS product_column, count(*) AS n_rows FROM ledger
    UNION ALL SELECT 'older_ledger', 'v4', 0.5, 'Cantidad,Producto_id,Tipo_movimiento', 'Producto_id', count(*) FROM ledger
    UNION ALL SELECT 'stock', 'legacy', 0.5, 'Codigo,Documento,Entrada_unid,Fecha,Saldo_unid,Salida_unid', 'Codigo', count(*) FROM stock""",
)
def detected_versions(spark, sf):
    raw = tpch.raw_ledger(spark, sf)
    old = V.movements_to_legacy(raw)
    stock = C.stock(spark, sf)
    tables = {"ledger": raw, "older_ledger": old, "stock": stock}
    counts = None
    for name, df in tables.items():
        found = V.detect_version(df.columns)
        names = V.column_names(found["is_v4"])
        one = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table"), F.lit(found["version"]).alias("version"), F.lit(found["confidence"]).alias("confidence"),
            F.lit(",".join(found["missing_columns"])).alias("missing"), F.lit(names["product"]).alias("product_column"), "n_rows",
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(
    "filtered_movements",
    T.chain(T.LEDGER)
    + " SELECT product_id, date, doc, channel, qty FROM ledger WHERE kind = 'sale' AND doc IN ('GU', 'CO') AND channel = '2-HIGH' ORDER BY date, ok, ln, pk, sk LIMIT 300",
)
def filtered_movements(spark, sf):
    rows = ledger(spark, sf, "product_id", "date", "kind", "doc", "channel", "qty", "row_seq")
    picked = rows.where((F.col("kind") == S.SALE) & F.col("doc").isin("GU", "CO") & (F.col("channel") == "2-HIGH"))
    return picked.orderBy("date", "row_seq").limit(300).select("product_id", "date", "doc", "channel", "qty")
