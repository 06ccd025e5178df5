"""Typing, validation and rejection of raw movement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import balance_broken, expected_balance, strip, to_day, to_int, to_number
from demandry.sources.files import require


def typed(raw: DataFrame) -> DataFrame:
    """Raw text ledger under our names with types; unreadable values become null. No row is dropped."""
    require(raw, S.REQUIRED)
    out = []
    for c in raw.columns:
        name = S.LEDGER_NAMES.get(c, c)
        if name in S.NUMERIC:
            e = to_number(c)
        elif name == "date":
            e = to_day(c)
        elif name in ("year", "month_no", "day"):
            e = to_int(c)
        elif name == "kind":
            k = strip(c)
            e = F.when(k == S.SALE_LABEL, F.lit(S.SALE)).when(k == S.PRODUCTION_LABEL, F.lit(S.PRODUCTION)).otherwise(k)
        elif name in ("product_id", "product_name"):
            e = strip(c)
        else:
            e = F.col(c)
        out.append(e.alias(name))
    return raw.select(*out)


def coherent(df: DataFrame, tolerance: float = S.STOCK_TOLERANCE) -> DataFrame:
    """Drop rows whose stated balance does not follow from the movement."""
    return df.where(~balance_broken(tolerance))


def complete_rows(df: DataFrame) -> DataFrame:
    """Drop rows without date, product, kind or quantity."""
    return df.dropna(subset=["date", "product_id", "kind", "qty"]).where(strip("product_id") != "")


def clean(raw: DataFrame, tolerance: float = S.STOCK_TOLERANCE, read: Observation | None = None) -> DataFrame:
    """Raw ledger to typed movements that can be added up. One narrow pass, no shuffle.

    ``read`` counts the rows before any is dropped. That is done on the typed rows: conditions are not moved below it, so no
    field is parsed once more for each place where a condition names it."""
    rows = typed(raw)
    rows = rows if read is None else rows.observe(read, F.count("*").alias("n"))
    return complete_rows(coherent(rows, tolerance))


def rejection_reason(tolerance: float = S.STOCK_TOLERANCE) -> Column:
    """Why :func:`clean` would drop a typed row; null if it keeps it."""
    return (
        F.when(balance_broken(tolerance), "balance")
        .when(F.col("date").isNull(), "date")
        .when(F.col("product_id").isNull() | (strip("product_id") == ""), "product")
        .when(F.col("kind").isNull(), "kind")
        .when(F.col("qty").isNull(), "quantity")
    )


def cleaning_summary(typed_rows: DataFrame, tolerance: float = S.STOCK_TOLERANCE) -> DataFrame:
    """Rows read and kept, and what the kept rows cover; one pass over the typed rows."""
    keep = rejection_reason(tolerance).isNull()
    of = lambda c: F.when(keep, F.col(c))
    n, k = F.count("*"), F.count_if(keep)
    return typed_rows.agg(
        n.alias("n_read"),
        k.alias("n_kept"),
        F.when(n > 0, 100.0 * k / n).otherwise(F.lit(0.0)).alias("kept_pct"),
        F.min(of("date")).alias("first_date"),
        F.max(of("date")).alias("last_date"),
        F.count_distinct(of("product_id")).alias("n_products"),
        F.count_if(keep & (F.col("kind") == S.SALE)).alias("n_sales"),
        F.count_if(keep & (F.col("kind") == S.PRODUCTION)).alias("n_productions"),
    )


def coherence_report(df: DataFrame) -> DataFrame:
    """Rows that meet and violate before -/+ quantity = after exactly, per kind."""
    ok = expected_balance() == F.col("stock_after")
    return df.groupBy("kind").agg(
        F.count("*").alias("n_rows"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_violations"),
        (100.0 * F.count_if(ok) / F.count("*")).alias("ok_pct"),
    )


def coherence_examples(df: DataFrame, order: list[Column], n: int = 3) -> DataFrame:
    """The first ``n`` violating rows."""
    return (
        df.withColumn("expected", expected_balance()).where(F.col("expected") != F.col("stock_after"))
        .orderBy(*order).limit(n).select("product_id", "date", "kind", "qty", "stock_before", "expected", "stock_after")
    )


def plain_codes(df: DataFrame, code: str = "product_id") -> DataFrame:
    """Drop products whose code holds a quote or a bracket."""
    return df.where(~F.coalesce(F.col(code).rlike(r"['()]"), F.lit(False)))


def catalogue_subset(df: DataFrame, pattern: str = "caja|tablero", n: int = 20) -> DataFrame:
    """Rows of ``n`` products: those whose name matches first, topped up with others, by code."""
    relevant = F.coalesce(F.col("product_name").rlike(f"(?i){pattern}"), F.lit(False))
    chosen = (
        df.groupBy("product_id").agg(F.max(relevant).alias("relevant"))
        .orderBy(F.desc("relevant"), "product_id").limit(n).select("product_id")
    )
    return df.join(F.broadcast(chosen), "product_id", "left_semi")


def line_value(df: DataFrame, max_discount: float = 50.0) -> DataFrame:
    """Discount kept in [0, max], a whole quantity of at least 1, and the line value that follows.

    The quantity is what went out, or what came in if nothing went out.
    """
    disc = F.least(F.greatest(F.coalesce(F.col("discount_pct"), F.lit(0.0)), F.lit(0.0)), F.lit(max_discount))
    units = F.greatest(F.when(F.col("out_units") > 0, F.col("out_units")).otherwise(F.col("in_units")).cast("bigint"), F.lit(1))
    return df.withColumn("discount_pct", disc).withColumn("units", units).withColumn(
        "line_value", F.col("base_price") * F.col("units") * (1 - F.col("discount_pct") / 100)
    )
