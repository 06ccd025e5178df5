"""From raw ledger rows to the three monthly tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry import schema as S
from demandry.functions.columns import strip, to_day, to_number
from demandry.operators import build as B
from demandry.operators import clean as C
from demandry.operators import convert as V
from demandry.session import materialize, sparing
from demandry.sources import files
from demandry.sources import headers as H
from demandry.sources import snapshot


@dataclass
class LoadResult:
    movements: DataFrame | None = None
    demand_monthly: DataFrame | None = None
    stock_monthly: DataFrame | None = None
    error: str | None = None
    # Demand and stock of movements that are written, as of this load's format.
    monthly: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def monthly_tables(raw: DataFrame, keep: bool = False) -> LoadResult:
    """Clean a daily ledger and build demand and stock. Its sales need no reconciliation.

    ``keep`` writes the cleaned rows to the shared folder once, for callers that use several of the
    tables; otherwise the tables are lazy views on ``raw``.
    """
    cleaned = C.clean(raw)
    cleaned = cleaned.withColumn("month", F.trunc("date", "month"))
    monthly = lambda rows, order: (B.demand_monthly(rows), B.stock_monthly(rows, order=order))
    return _with_tables(cleaned, monthly, keep)


def _with_tables(rows: DataFrame, monthly: Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame]], keep: bool) -> LoadResult:
    # Files are ranked where the rows are written; else they would be parsed once more for it.
    of_written = lambda df: monthly(*files.ranked_sources(df, _order(df)))
    if keep:
        rows = materialize(rows, "movements")
    return LoadResult(rows, *(of_written(rows) if keep else monthly(rows, _order(rows))), monthly=of_written)


def legacy_movements(raw: DataFrame) -> DataFrame:
    """Older ledger rows under our names with types; rows without a date or a product are dropped."""
    files.require(raw, S.LEGACY_REQUIRED)
    out = []
    for c in raw.columns:
        name = S.LEGACY_NAMES.get(c, c)
        e = to_number(c) if name in S.NUMERIC else to_day(c) if name == "date" else strip(c) if name in ("product_id", "doc", "doc_no") else F.col(c)
        out.append(e.alias(name))
    df = raw.select(*out)
    for c in ("doc_no", "warehouse"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.dropna(subset=["date", "product_id"]).where(F.col("product_id") != "").withColumn("month", F.trunc("date", "month"))


def legacy_tables(
    raw: DataFrame, keep: bool = False, *, sale_docs: list[str] = [S.DOC_STORE_SALE], consumption_docs: list[str] = [S.DOC_CONSUMPTION],  # noqa: B006
    guide_docs: list[str] = [S.DOC_GUIDE],  # noqa: B006
) -> LoadResult:
    """Older ledger: demand from sales, consumption and external guides; stock per product and warehouse."""
    rows = B.reconcile_guides(legacy_movements(raw), guide_docs)

    def monthly(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
        demand = B.demand_components(rows, sale_docs, consumption_docs).select("product_id", "month", "demand")
        return demand, B.stock_monthly(rows, ["product_id", "warehouse"], order)

    return _with_tables(rows, monthly, keep)


def _order(rows: DataFrame) -> list[str]:
    """Order within a month: by day, then as the files were given."""
    return ["date", *[c for c in files.FILE_ORDER if c in rows.columns]]


def _format(found: list[H.Header], sep: str | None) -> str:
    """The one format of all files, told by their headers. A file of neither format is refused by name."""
    known, unknown = [], []
    for h in found:
        columns = [c.strip().strip('"') for c in re.split(re.escape(sep) if sep else "[;,]", h.line)]
        try:
            V.detect_format(columns)
            known.append(columns)
        except ValueError:
            unknown.append(h)
    # Which format it should have had, the files beside it tell.
    legacy = bool(known) and V.common_format(known) == "legacy"
    H.refuse([replace(h, sep=sep or (";" if ";" in h.line else ",")) for h in unknown], S.LEGACY_REQUIRED if legacy else S.REQUIRED)
    return "legacy" if legacy else "v4"


def run(spark: SparkSession, paths: list[str], keep: bool = True, *, sep: str | None = None, encoding: str = "UTF-8") -> LoadResult:
    """Load ledger files of one format, told by their headers.

    ``sep`` is that of the format unless given. A bad layout, a mixed batch or a missing file comes back as
    ``error`` instead of an exception.
    """
    try:
        if not paths:
            return LoadResult(error="no files given")
        table = H.file_table(spark, paths, encoding)
        if _format(H.headers(table), sep) == "legacy":
            result = legacy_tables(files.read_legacy(spark, paths, encoding, sep or ";", table), keep)
        else:
            result = monthly_tables(files.read_ledger(spark, paths, sep or ",", encoding, table), keep)
        if result.movements.isEmpty():
            return LoadResult(error="no valid rows after cleaning")
        return result
    except ValueError as e:
        return LoadResult(error=str(e))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return LoadResult(error=f"file not found: {e.getMessageParameters().get('path')}")


def run_and_store(spark: SparkSession, paths: list[str], root: str, org_id: str, **reading: str) -> LoadResult:
    """Load an organization's files and make the results its stored ones, with the number of files and the time.

    The movements are written into the store at once, and demand and stock are built from them there. A load that fails
    leaves what is stored as it was.
    """
    result = run(spark, paths, keep=False, **reading)
    if result.ok:
        owned = lambda df: df.drop("org_id").withColumn("org_id", F.lit(org_id))
        tables = {
            "movements": owned(result.movements),
            "demand_monthly": lambda stored: owned(result.monthly(stored["movements"].drop("org_id"))[0]),
            "stock_monthly": lambda stored: owned(result.monthly(stored["movements"].drop("org_id"))[1]),
        }
        n_files = H.list_files(spark, paths).count()
        org = spark.createDataFrame([(org_id,)], "org_id string")
        with sparing(spark):
            stored = snapshot.save_snapshot(tables, root, org, n_files, one=True)
        result = LoadResult(*[stored[name].drop("org_id") for name in tables])
    return result
