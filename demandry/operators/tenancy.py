"""Queries over organizations, users, roles, uploads and stored analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.operators import analytics as A
from demandry.session import grouped_for


def permission_table(spark: SparkSession) -> DataFrame:
    """(role, permission); a fixed handful of rows."""
    return spark.createDataFrame([(r, p) for r, ps in S.ROLE_PERMISSIONS.items() for p in ps], "role string, permission string")


def user_organizations(assignments: DataFrame, organizations: DataFrame, user_id: str | None = None) -> DataFrame:
    """Organizations and role of one user, or of every user."""
    mine = assignments if user_id is None else assignments.where(F.col("user_id") == user_id)
    return mine.join(organizations, "org_id").select("user_id", "org_id", "org_name", "role")


def organization_members(assignments: DataFrame, users: DataFrame, org_id: str | None = None) -> DataFrame:
    theirs = assignments if org_id is None else assignments.where(F.col("org_id") == org_id)
    return theirs.join(users, "user_id").select("org_id", "user_id", "user_name", "role")


def role_in(assignments: DataFrame, roles: DataFrame, user_id: str, org_id: str) -> DataFrame:
    return assignments.where((F.col("user_id") == user_id) & (F.col("org_id") == org_id)).join(roles, "role").select("user_id", "org_id", "role")


def with_permission(assignments: DataFrame, permissions: DataFrame, permission: str) -> DataFrame:
    """Assignments whose role holds the permission."""
    return assignments.join(permissions.where(F.col("permission") == permission), "role").select("user_id", "org_id", "role", "permission")


def log_upload(entry: DataFrame, path: str) -> None:
    grouped_for(entry, "org_id").write.mode("append").partitionBy("org_id").parquet(path)


def newest(df: DataFrame, keys: list[str], created: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key. The rank limit is applied before the shuffle, so a hot key is cheap."""
    w = Window.partitionBy(*keys).orderBy(F.desc(created), F.desc(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def visible_rows(rows: DataFrame, assignments: DataFrame, user_id: str) -> DataFrame:
    """Rows of the organizations assigned to the user; all rows for a master."""
    mine = assignments.where(F.col("user_id") == user_id)
    master = mine.agg(F.coalesce(F.max(F.col("role") == S.MASTER_ROLE), F.lit(False)).alias("m")).scalar()
    # A semi join each way: a user's few organizations, or, for a master, those of the rows. Adaptive execution sends
    # the short side to the rows, or splits a large organization, by the sizes it meets.
    orgs = mine.where(~master).select("org_id").union(rows.select("org_id").distinct().where(master)).distinct()
    return rows.join(orgs, "org_id", "left_semi")


def all_users(users: DataFrame, assignments: DataFrame, organizations: DataFrame) -> DataFrame:
    """Every user with organization and role; users without one get the defaults."""
    return users.join(assignments, "user_id", "left").join(organizations, "org_id", "left").select(
        "user_id", "user_name", F.coalesce("org_name", F.lit("Sin Org")).alias("org_name"), F.coalesce("role", F.lit("viewer")).alias("role")
    )


def users_without_org(users: DataFrame, assignments: DataFrame) -> DataFrame:
    return users.join(assignments, "user_id", "left_anti")


def user_counts(users: DataFrame, assignments: DataFrame) -> DataFrame:
    linked = assignments.select("user_id").distinct().withColumn("__has", F.lit(True))
    return users.join(linked, "user_id", "left").agg(
        F.count("*").alias("n_users"), F.count("__has").alias("n_with_org"), F.count_if(F.col("__has").isNull()).alias("n_without_org")
    )


# Between organization and product in a combined key; no identifier holds it.
_BETWEEN = "\x1f"


def organization_of(product: str = "product_id") -> Column:
    return F.split_part(F.col(product), F.lit(_BETWEEN), F.lit(1))


def scoped(df: DataFrame) -> DataFrame:
    """Rows of several organizations with products told apart by organization: ``product_id`` takes ``org_id`` in.

    All operators by product then work per organization: two organizations' products of one code never mix."""
    return df.withColumn("product_id", F.concat_ws(_BETWEEN, "org_id", "product_id")).drop("org_id")


def split_scope(df: DataFrame) -> DataFrame:
    """The reverse of :func:`scoped`, for results."""
    rest = [c for c in df.columns if c != "product_id"]
    return df.select(organization_of().alias("org_id"), F.split_part("product_id", F.lit(_BETWEEN), F.lit(2)).alias("product_id"), *rest)


def abc_by_organization(demand: DataFrame) -> DataFrame:
    """ABC classes inside each organization, for scoped demand."""
    return scoped(A.abc(split_scope(demand), ["org_id"]))
