"""Incremental and live processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import strip, to_number
from demandry.session import fresh_path, materialize, sparing
from demandry.sources import files, layouts, tpch
from demandry.sources import headers as H
from demandry.streaming import ingest, live
from suite import twin as T
from suite.registry import each, query

_KEPT = "ok % 211 <> 0 AND ok % 307 <> 0 AND ok % 199 <> 0 AND ok % 101 <> 0"


def _two_batches(spark, sf):
    """Two arrivals whose months overlap, as two runs of the ingest."""
    root = fresh_path(spark, "ingest")
    early, half = F.col("Año") < "1999", F.col("Cantidad").contains("1")
    inbox, store = f"{root}/inbox", ingest.Store(f"{root}/store")
    with sparing(spark) as held:
        # Every arrival is cut from it, so it is worked out once.
        with sparing(spark) as sources:
            raw = materialize(tpch.raw_ledger(spark, sf), "raw")
            held.append(sources.pop())
        for k, arrival in enumerate((raw.where(early | half), raw.where(~early & ~half))):
            files.write_csv(arrival, f"{root}/{k}", compression="gzip")
    with sparing(spark):
        for k in range(2):
            _arrive(spark, f"{root}/{k}", inbox)
            ingest.ingest(spark, inbox, store).awaitTermination()
    return store


def _arrive(spark, path, inbox):
    """The part files of a folder come into the inbox."""
    there = spark._jvm.org.apache.hadoop.fs.Path(inbox)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(there)
    for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path)):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(there, f.getPath().getName()))


@query("ingest_demand", T.chain(T.LEDGER) + f" SELECT product_id, month, abs(sum(qty)) AS demand FROM ledger WHERE kind = 'sale' AND {_KEPT} GROUP BY product_id, month")
def ingest_demand(spark, sf):
    return spark.read.parquet(_two_batches(spark, sf).path("demand_monthly")).select("product_id", "month", "demand")


@query(
    "ingest_audit",
    T.chain(T.LEDGER)
    + f""", arrivals AS (SELECT *, CASE WHEN year < 1999 OR contains(CASE WHEN ok % 307 = 0 THEN '1,' ELSE '' END || CAST(CAST(qty AS BIGINT) AS VARCHAR), '1') THEN 0 ELSE 1 END AS batch_id FROM ledger),
    kept AS (SELECT * FROM arrivals WHERE {_KEPT})
    SELECT CAST(b.batch_id AS INTEGER) AS batch_id, (SELECT count(*) FROM arrivals a WHERE a.batch_id = b.batch_id) AS n_raw, (SELECT count(*) FROM kept k WHERE k.batch_id = b.batch_id) AS n_clean,
      (SELECT count(DISTINCT (product_id, month)) FROM kept k WHERE kind = 'sale' AND k.batch_id <= b.batch_id AND month IN (SELECT month FROM kept m WHERE m.batch_id = b.batch_id)) AS n_demand,
      (SELECT count(DISTINCT (product_id, month)) FROM kept k WHERE k.batch_id <= b.batch_id AND month IN (SELECT month FROM kept m WHERE m.batch_id = b.batch_id)) AS n_stock
    FROM (VALUES (0), (1)) b(batch_id)""",
)
def ingest_audit(spark, sf):
    return spark.read.parquet(_two_batches(spark, sf).path("audit")).drop("processed_at")


# Organizations, how each writes its files, and their configuration as it is stored. The files of the third lack a column.
_LAYOUTS = {"org0": (",", "UTF-8"), "org1": (";", "ISO-8859-1"), "org2": (",", "UTF-8")}
_RENAMED = {"Producto_id": "Código", "Cantidad": "Unidades"}


def _tenant_files(spark, sf, root, held):
    """Files of three organizations in two arrivals, and the configuration rows. The ledger that they are cut from is added to ``held``."""
    # Every file is cut from it, so it is worked out once.
    with sparing(spark) as sources:
        raw = materialize(tpch.raw_ledger(spark, sf, org=True), "raw")
        held.append(sources.pop())
    columns = [c for c in raw.columns if c != "org_id"]
    rows = []
    for org, (sep, encoding) in _LAYOUTS.items():
        renamed = _RENAMED if org == "org1" else {}
        names = ", ".join(f'"{c}": "{renamed.get(c, c)}"' for c in columns)
        rows.append((org, sep, encoding, "{" + names + "}"))
    config = spark.createDataFrame(rows, "organization_id string, csv_separator string, csv_encoding string, column_mapping string")

    def write(arrival: int) -> None:
        late = F.col("Año") >= "1999"
        for org, (sep, encoding) in _LAYOUTS.items():
            mine = raw.where((F.col("org_id") == org) & (late if arrival else ~late)).select(*columns)
            mine = mine.withColumnsRenamed(_RENAMED) if org == "org1" else mine.drop("Cantidad") if org == "org2" else mine
            files.write_csv(mine, f"{root}/{org}/raw/{arrival}", sep, encoding=encoding, compression="gzip")

    return config, write


def _by_organization(spark, sf):
    root = fresh_path(spark, "tenants")
    inbox, store = f"{root}/inbox", ingest.Store(f"{root}/store")
    run = lambda: ingest.ingest(spark, inbox, store, config=config).awaitTermination()
    with sparing(spark) as held:
        config, write = _tenant_files(spark, sf, inbox, held)
        write(0)
        run()
        write(1)
    with sparing(spark):
        run()
    return store


_TWO_ORGS = "org_id IN ('org0', 'org1')"


@query(
    "ingest_by_organization",
    T.chain(T.LEDGER)
    + f""", kept AS (SELECT * FROM ledger WHERE {_TWO_ORGS} AND {_KEPT}),
    ends AS (SELECT *, row_number() OVER (PARTITION BY org_id, product_id, month ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY org_id, product_id, month, date) AS same FROM kept),
    last AS (SELECT org_id, product_id, month, stock_after AS stock FROM ends WHERE k = 1 AND same = 1)
    SELECT k.org_id, k.product_id, k.month, abs(sum(qty) FILTER (kind = 'sale')) AS demand, any_value(last.stock) AS stock
    FROM kept k LEFT JOIN last ON last.org_id = k.org_id AND last.product_id = k.product_id AND last.month = k.month GROUP BY k.org_id, k.product_id, k.month""",
)
def ingest_by_organization(spark, sf):
    """Demand, and the stock where one movement alone ends the month (the files give no order to others)."""
    store = _by_organization(spark, sf)
    read = lambda name: spark.read.parquet(store.path(name))
    keys = ["org_id", "product_id", "month"]
    last = _last_day(read("ledger"), keys)
    stock = read("stock_monthly").join(last.where("n = 1"), keys, "left").select(*keys, F.when(F.col("n") == 1, F.col("stock")).alias("stock"))
    return stock.join(read("demand_monthly"), keys, "left").select(*keys, "demand", "stock")


def _last_day(rows, keys):
    """Movements on the last day of each month."""
    per_day = rows.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    return per_day.groupBy(*keys).agg(F.max_by("n", "date").alias("n"))


@query(
    "ingest_quarantine",
    T.chain(T.LEDGER)
    + """ SELECT org_id, CAST(year >= 1999 AS INTEGER) AS batch_id, 'missing columns' AS verdict, 'Cantidad' AS missing, count(*) AS n_rows
    FROM ledger WHERE org_id = 'org2' GROUP BY ALL""",
)
def ingest_quarantine(spark, sf):
    """The refused files, and how many rows they hold back."""
    refused = ingest.quarantine(spark, _by_organization(spark, sf))
    rows = H.data_lines(refused)
    return rows.groupBy("org_id", "batch_id", "verdict", F.array_join("missing", ",").alias("missing")).agg(F.sum("n_lines").cast("bigint").alias("n_rows"))


@query(
    "tenant_layouts",
    T.chain(T.LEDGER)
    + f"""SELECT org_id, product_id AS product, count(*) AS n, sum(CASE WHEN ok % 307 = 0 THEN NULL ELSE qty END) AS quantity
    FROM ledger WHERE {_TWO_ORGS} AND ok % 199 <> 0 GROUP BY org_id, product_id""",
)
def tenant_layouts(spark, sf):
    root = fresh_path(spark, "tenants")
    with sparing(spark) as held:
        config, write = _tenant_files(spark, sf, root, held)
        write(0)
        write(1)
    rows = layouts.read_tenants(spark, root, config, S.REQUIRED).rows
    typed = rows.select("org_id", strip("Producto_id").alias("product"), to_number("Cantidad").alias("qty"))
    return typed.where("product <> ''").groupBy("org_id", "product").agg(F.count("*").alias("n"), F.sum("qty").alias("quantity"))


@query(
    "live_daily_totals",
    "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2",
    each("total", 4),
)
def live_daily_totals(spark, sf):
    root = fresh_path(spark, "live")
    schema = tpch.table(spark, sf, "events").schema
    # Watermarks need a timestamp with time zone.
    events = live.read_events(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    daily = live.daily_totals(events, "event_type", "value")
    live.start_daily(daily, f"{root}/daily", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/daily")


@query(
    "live_monthly_totals",
    """SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, sum(value) AS total FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""",
    each("total", 4),
)
def live_monthly_totals(spark, sf):
    return live.monthly_from_daily(live_daily_totals(spark, sf), "event_type")
