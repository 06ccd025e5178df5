"""The movement ledger as a view over order/line tables, plus the tenant tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry import schema as S
from demandry.functions.ordered import running_balance, running_balance_by_key
from demandry.session import drop, fresh_path, owned, parts_for, sparing

# Row numbers are cut into blocks of this many orders; a block holds a bounded number of rows.
_BLOCK_BITS = 20
# Sales channels that have a point of sale.
PHYSICAL_CHANNELS = ["1-URGENT", "2-HIGH"]

# Column -> tables needed on top of lineitem. Only the joins a query asks for are planned.
_NEEDS = {
    "product_name": {"part"}, "brand": {"part"}, "product_type": {"part"},
    "warehouse": {"supplier"},
    "channel": {"orders"}, "pos": {"orders"},
    "client": {"orders", "customer"}, "campaign": {"orders", "customer"},
    "department": {"orders", "customer", "nation"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _expressions() -> dict[str, Column]:
    sale = F.col("l_returnflag") != "R"
    day = F.col("l_shipdate").cast("date")
    qty = F.col("l_quantity")
    doc = F.element_at(
        F.array(F.lit(S.DOC_STORE_SALE), F.lit(S.DOC_CONSUMPTION), F.lit(S.DOC_GUIDE)), (F.col("l_linenumber") % 3 + 1).cast("int")
    )
    physical = F.col("o_orderpriority").isin(*PHYSICAL_CHANNELS)
    pos_name = F.concat(F.lit("POS "), (F.col("l_suppkey") % 2 + 1).cast("string"))
    return {
        "org_id": F.concat(F.lit("org"), (F.col("l_suppkey") % 5).cast("string")),
        "date": day,
        "month": F.trunc(day, "month"),
        "year": F.year(day),
        "month_no": F.month(day),
        "day": F.dayofmonth(day),
        "product_id": F.col("l_partkey").cast("string"),
        "kind": F.when(sale, F.lit(S.SALE)).otherwise(F.lit(S.PRODUCTION)),
        "qty": qty,
        "unit_price": F.when(sale, F.col("l_extendedprice") / qty),
        "discount_pct": F.when(sale, 100 * F.col("l_discount")),
        "total_value": F.when(sale, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(F.col("l_extendedprice")),
        "unit_cost": F.when(~sale, F.col("l_extendedprice") / qty),
        "doc": doc,
        "doc_no": (F.col("l_suppkey") % 3).cast("string"),
        "in_units": F.when(sale, F.lit(0.0)).otherwise(qty),
        "out_units": F.when(sale, qty).otherwise(F.lit(0.0)),
        "row_block": F.shiftright(F.col("l_orderkey"), _BLOCK_BITS),
        "row_seq": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "product_name": F.col("p_name"),
        "brand": F.col("p_brand"),
        "product_type": F.col("p_type"),
        "warehouse": F.concat(F.lit("W"), F.col("s_nationkey").cast("string")),
        "channel": F.when(sale, F.col("o_orderpriority")),
        "pos": F.when(
            sale & ((physical & (F.col("l_linenumber") != 7)) | (~physical & (F.col("l_orderkey") % 101 == 0))), pos_name
        ),
        "client": F.when(sale, F.col("c_name")),
        "campaign": F.when(sale, F.col("c_mktsegment")),
        "department": F.when(sale, F.col("n_name")),
    }


def ledger(spark: SparkSession, sf_dir: str, *columns: str, by_brand: bool = False, by_org: bool = False) -> DataFrame:
    """The movement ledger with the named columns; ``by_brand`` makes the brand the product, ``by_org`` tells the
    products of each organization apart."""
    ex = _expressions()
    wanted = list(columns)
    needs = set().union(*[_NEEDS.get(c, set()) for c in wanted], {"part"} if by_brand else set())
    if by_brand:
        ex["product_id"] = F.col("p_brand")
    if by_org:
        ex["product_id"] = F.concat_ws("\x1f", ex["org_id"], ex["product_id"])
    return _joined(spark, sf_dir, needs).select(*[ex[c].alias(c) for c in wanted])


def _joined(spark: SparkSession, sf_dir: str, needs: set[str]) -> DataFrame:
    """Lines with the columns of the tables in ``needs``; a line without its row in one of them is left out."""
    out = table(spark, sf_dir, "lineitem")
    on = {
        "part": F.col("l_partkey") == F.col("p_partkey"),
        "supplier": F.col("l_suppkey") == F.col("s_suppkey"),
        "orders": F.col("l_orderkey") == F.col("o_orderkey"),
        "customer": F.col("o_custkey") == F.col("c_custkey"),
        "nation": F.col("c_nationkey") == F.col("n_nationkey"),
    }
    # Orders meet their customers and nations before the lines meet them: a line is shuffled once for all three.
    chain = [name for name in ("orders", "customer", "nation") if name in needs]
    if chain:
        orders = table(spark, sf_dir, chain[0])
        for name in chain[1:]:
            orders = orders.join(table(spark, sf_dir, name), on[name])
        out = out.join(orders, on["orders"])
    for name in ("part", "supplier"):
        if name in needs:
            out = out.join(table(spark, sf_dir, name), on[name])
    return out


def balanced_ledger(spark: SparkSession, sf_dir: str, *columns: str, opening: float = 10_000.0, by_brand: bool = False, by_org: bool = False) -> DataFrame:
    """:func:`ledger` with ``stock_before`` and ``stock_after`` per product."""
    base = ["product_id", "date", "month", "kind", "qty", "row_block", "row_seq"]
    rows = ledger(spark, sf_dir, *base, *[c for c in columns if c not in base], by_brand=by_brand, by_org=by_org)
    signed = F.when(F.col("kind") == S.SALE, -F.col("qty")).otherwise(F.col("qty"))
    out = running_balance(
        rows, signed, keys=["product_id"], coarse="month", fine=["date", "row_block"], order=["row_seq"], out="stock_after"
    ).withColumn("stock_after", F.col("stock_after") + opening)
    return out.withColumn("stock_before", F.col("stock_after") - signed)


def _wide_ledger(spark: SparkSession, sf_dir: str, opening: float = 10_000.0) -> DataFrame:
    """Lines with the names of their product, client and department, balanced by product, written to the shared folder.

    The lines meet their orders once and are written by groups of products. Each group is then shuffled by product, for its
    names and its balance at once, and its lines go: so little of the disk holds shuffled rows at any time.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    columns = [*keys, "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", "o_orderpriority", "c_name", "c_mktsegment", "n_name"]
    lines = _joined(spark, sf_dir, {"orders", "customer", "nation"}).select(*columns).where(F.col("l_partkey").isNotNull())
    stored = T.StructType([*lines.schema.fields, T.StructField("slice", T.IntegerType())])
    names, n = table(spark, sf_dir, "part").select("p_partkey", "p_name"), parts_for(table(spark, sf_dir, "lineitem"))
    slice_of = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int")
    ex = _expressions()
    signed = F.when(ex["kind"] == S.SALE, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held, path = fresh_path(spark, "lines"), fresh_path(spark, "wide")
    with sparing(spark):
        lines.withColumn("slice", slice_of("l_partkey")).write.partitionBy("slice").parquet(held)
        for k in range(n):
            mine = spark.read.schema(stored).parquet(held).where(F.col("slice") == k).drop("slice")
            rows = mine.join(names.where(slice_of("p_partkey") == k), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
            rows = rows.withColumns({c: ex[c] for c in ("month", "date", "row_block")})
            out = running_balance_by_key(rows, signed, keys=["l_partkey"], coarse="month", fine=["date", "row_block"], order=keys, out="balance")
            out.drop("month", "date", "row_block").write.mode("append").parquet(path)
            drop(spark, f"{held}/slice={k}")
        drop(spark, held)
    owned(path)
    after = F.col("balance") + opening
    return spark.read.parquet(path).withColumns({"stock_after": after, "stock_before": after - signed}).drop("balance")


def raw_ledger(spark: SparkSession, sf_dir: str, places: bool = False, org: bool = False) -> DataFrame:
    """The ledger as it would arrive in a file: all text, input headers, a known set of dirty rows.

    ``places`` keeps the order of the rows (row_block, row_seq), as the file reader gives it; ``org`` adds org_id.

    Rows with the stated order-number multiples get another date format (97), no date (211), a comma
    decimal (89), a blank inside the number (83), two separators (307), a blank product (199), padded text (53),
    or a wrong balance (101).
    """
    columns = [
        "product_id", "date", "kind", "qty", "row_block", "row_seq", "year", "month_no", "day", "product_name", "client", "department", "channel", "pos",
        "unit_price", "discount_pct", "total_value", "campaign", "unit_cost", *(["org_id"] if org else []),
    ]
    ex = _expressions()
    full = _wide_ledger(spark, sf_dir).select(*[ex[c].alias(c) for c in columns], "stock_before", "stock_after")
    key = F.col("row_seq.l_orderkey")
    every = lambda n: key % n == 0
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    pad = lambda c: F.when(every(53), F.concat(F.lit(" "), c, F.lit(" "))).otherwise(c)
    fecha = (
        F.when(every(211), F.lit("abc"))
        .when(every(97), F.date_format("date", "dd/MM/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    cantidad = (
        F.when(every(307), F.concat(F.lit("1,"), whole("qty"), F.lit(".5")))
        .when(every(89), F.concat(whole("qty"), F.lit(",0")))
        .when(every(83), F.concat(F.lit(" "), whole("qty"), F.lit(" ")))
        .otherwise(whole("qty"))
    )
    kind = F.when(F.col("kind") == S.SALE, F.lit(S.SALE_LABEL)).otherwise(F.lit(S.PRODUCTION_LABEL))
    after = F.when(every(101), F.col("stock_after") * 2 + 7).otherwise(F.col("stock_after")).cast("bigint").cast("string")
    return full.select(
        fecha.alias("Fecha"),
        F.col("year").cast("string").alias("Año"),
        F.col("month_no").cast("string").alias("Mes"),
        F.col("day").cast("string").alias("Dia"),
        F.when(every(199), F.lit("  ")).otherwise(pad(F.col("product_id"))).alias("Producto_id"),
        pad(F.col("product_name")).alias("Producto_nombre"),
        F.col("client").alias("Empresa_cliente"),
        F.col("department").alias("Departamento_cliente"),
        F.col("channel").alias("Canal_venta"),
        F.col("pos").alias("Punto_venta"),
        pad(kind).alias("Tipo_movimiento"),
        cantidad.alias("Cantidad"),
        whole("stock_before").alias("Stock_anterior"),
        after.alias("Stock_posterior"),
        F.col("unit_price").cast("string").alias("Precio_unitario"),
        F.col("discount_pct").cast("string").alias("Descuento_pct"),
        F.col("total_value").cast("string").alias("Valor_total"),
        F.col("campaign").alias("Campana"),
        F.col("unit_cost").cast("string").alias("Costo_unitario"),
        *(["row_block", "row_seq"] if places else []),
        *(["org_id"] if org else []),
    )


def tenancy(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Organizations, users, roles, assignments, uploads and analyses derived from the given tables."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    user = F.col("c_custkey").cast("string")
    role = (
        F.when(F.col("c_custkey") % 97 == 0, F.lit("master_admin"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("org_admin"))
        .otherwise(F.lit("viewer"))
    )
    org_of_user = F.col("c_nationkey").cast("string")
    with_org = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    roles = spark.createDataFrame([(r,) for r in S.ROLE_PERMISSIONS], "role string")
    return {
        "organizations": nation.select(F.col("n_nationkey").cast("string").alias("org_id"), F.col("n_name").alias("org_name")),
        "users": customer.select(user.alias("user_id"), F.col("c_name").alias("user_name")),
        "roles": roles,
        "assignments": customer.where(F.col("c_custkey") % 10 != 3).select(
            user.alias("user_id"), org_of_user.alias("org_id"), role.alias("role")
        ),
        "uploads": with_org.select(
            F.col("o_orderkey").cast("string").alias("upload_id"),
            org_of_user.alias("org_id"),
            user.alias("uploaded_by"),
            F.concat(F.lit("data_"), F.year("o_orderdate").cast("string"), F.lit(".csv")).alias("file_name"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderdate").cast("date").alias("uploaded_on"),
            F.col("o_orderstatus").alias("status"),
        ),
        "analyses": with_org.select(
            F.col("o_orderkey").cast("string").alias("analysis_id"),
            org_of_user.alias("org_id"),
            F.col("o_orderpriority").alias("analysis_type"),
            F.col("o_orderdate").cast("date").alias("created_on"),
            F.to_json(F.struct(F.col("o_totalprice").alias("total"))).alias("results"),
        ),
    }
