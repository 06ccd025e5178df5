"""Organizations, users, uploads and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandry.operators import analytics as A
from demandry.operators import tenancy as N
from demandry.session import fresh_path
from demandry.sources import snapshot, tpch
from demandry.sources.tpch import ledger
from suite import twin as T
from suite.registry import query

_TABLES = """WITH organizations AS (SELECT CAST(n_nationkey AS VARCHAR) AS org_id, n_name AS org_name FROM nation),
users AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS user_name FROM customer),
assignments AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS VARCHAR) AS org_id,
  CASE WHEN c_custkey % 97 = 0 THEN 'master_admin' WHEN c_mktsegment = 'MACHINERY' THEN 'org_admin' ELSE 'viewer' END AS role FROM customer WHERE c_custkey % 10 <> 3),
uploads AS (SELECT CAST(o_orderkey AS VARCHAR) AS upload_id, CAST(c_nationkey AS VARCHAR) AS org_id, CAST(c_custkey AS VARCHAR) AS uploaded_by,
  'data_' || CAST(year(o_orderdate) AS VARCHAR) || '.csv' AS file_name, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS uploaded_on, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey),
analyses AS (SELECT CAST(o_orderkey AS VARCHAR) AS analysis_id, CAST(c_nationkey AS VARCHAR) AS org_id, o_orderpriority AS analysis_type, CAST(o_orderdate AS DATE) AS created_on
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("user_organizations", _TABLES + " SELECT user_id, a.org_id, org_name, role FROM assignments a JOIN organizations o ON o.org_id = a.org_id")
def user_organizations(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.user_organizations(t["assignments"], t["organizations"])


@query("organization_members", _TABLES + " SELECT org_id, a.user_id, user_name, role FROM assignments a JOIN users u ON u.user_id = a.user_id WHERE org_id = '7'")
def organization_members(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.organization_members(t["assignments"], t["users"], "7")


@query("role_in_organization", _TABLES + " SELECT user_id, org_id, role FROM assignments WHERE user_id = '97' AND org_id = (SELECT CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 97)")
def role_in_organization(spark, sf):
    t = tpch.tenancy(spark, sf)
    org = t["assignments"].where(F.col("user_id") == "97").select("org_id").first()["org_id"]
    return N.role_in(t["assignments"], t["roles"], "97", org)


@query("newest_uploads", _TABLES + " SELECT org_id, upload_id, file_name, year, uploaded_on, status FROM uploads QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY uploaded_on DESC, upload_id DESC) <= 10")
def newest_uploads(spark, sf):
    path = fresh_path(spark, "uploads")
    uploads = tpch.tenancy(spark, sf)["uploads"]
    for y in (F.col("year") < 1998, F.col("year") >= 1998):
        N.log_upload(uploads.where(y), path)
    log = spark.read.schema(uploads.schema).parquet(path)
    return N.newest(log, ["org_id"], "uploaded_on", "upload_id", 10).select("org_id", "upload_id", "file_name", "year", "uploaded_on", "status")


@query("newest_analyses", _TABLES + " SELECT org_id, analysis_type, analysis_id, created_on FROM analyses QUALIFY row_number() OVER (PARTITION BY org_id, analysis_type ORDER BY created_on DESC, analysis_id DESC) <= 20")
def newest_analyses(spark, sf):
    rows = tpch.tenancy(spark, sf)["analyses"]
    return N.newest(rows, ["org_id", "analysis_type"], "created_on", "analysis_id", 20).select("org_id", "analysis_type", "analysis_id", "created_on")


@query("visible_uploads", _TABLES + " SELECT upload_id, org_id, year FROM uploads WHERE org_id IN (SELECT org_id FROM assignments WHERE user_id = '12')")
def visible_uploads(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.visible_rows(t["uploads"], t["assignments"], "12").select("upload_id", "org_id", "year")


@query("visible_uploads_master", _TABLES + " SELECT upload_id, org_id, year FROM uploads")
def visible_uploads_master(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.visible_rows(t["uploads"], t["assignments"], "97").select("upload_id", "org_id", "year")


@query(
    "all_users",
    _TABLES + " SELECT u.user_id, user_name, coalesce(org_name, 'Sin Org') AS org_name, coalesce(role, 'viewer') AS role FROM users u LEFT JOIN assignments a ON a.user_id = u.user_id LEFT JOIN organizations o ON o.org_id = a.org_id",
)
def all_users(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.all_users(t["users"], t["assignments"], t["organizations"])


@query("users_without_org", _TABLES + " SELECT * FROM users WHERE user_id NOT IN (SELECT user_id FROM assignments)")
def users_without_org(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.users_without_org(t["users"], t["assignments"])


@query("user_counts", _TABLES + " SELECT (SELECT count(*) FROM users) AS n_users, (SELECT count(DISTINCT user_id) FROM assignments) AS n_with_org, (SELECT count(*) FROM users) - (SELECT count(DISTINCT user_id) FROM assignments) AS n_without_org")
def user_counts(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.user_counts(t["users"], t["assignments"])


@query("users_who_may_upload", _TABLES + " SELECT user_id, org_id, role, 'upload_data' AS permission FROM assignments WHERE role IN ('master_admin', 'org_admin')")
def users_who_may_upload(spark, sf):
    t = tpch.tenancy(spark, sf)
    return N.with_permission(t["assignments"], N.permission_table(spark), "upload_data")


@query(
    "latest_result_per_product",
    T.chain(T.LEDGER)
    + """, r AS (SELECT org_id, product_id, month, sum(qty) AS units FROM ledger GROUP BY org_id, product_id, month)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY org_id, product_id ORDER BY month DESC) = 1""",
)
def latest_result_per_product(spark, sf):
    rows = ledger(spark, sf, "org_id", "product_id", "month", "qty").groupBy("org_id", "product_id", "month").agg(F.sum("qty").alias("units"))
    return snapshot.latest_per_key(rows, ["org_id", "product_id"], "month")
