"""Readers and writers for ledger files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry import schema as S
from demandry.functions.columns import strip, to_number
from demandry.functions.ordered import in_order
from demandry.session import grouped_for
from demandry.sources import headers as H
from demandry.sources.headers import MissingColumns


@dataclass(frozen=True)
class CsvLayout:
    """How one tenant's files are written, and which of our names each header stands for."""

    sep: str = ","
    encoding: str = "UTF-8"
    mapping: dict[str, str] = field(default_factory=dict)


def require(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` unchanged, or an error naming what is missing and what there is. Looks at the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; found {df.columns}")
    return df


def read_text_csv(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", *, required: list[str] | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Every column as text under its own header, headers trimmed, columns without a name left out.

    Files are read together with those of the same header line and the groups are joined by name, so neither
    the order of columns nor a missing one moves a value. A file that lacks a ``required`` column is refused by name.
    ``source_no`` (place of the given path), ``source_path``, ``row_block`` (the file split, bounded by the split size) and
    ``row_seq`` (the place in it) are the order of the rows as given; ``source_file`` is the file's bare name.
    ``table`` is the files' :func:`headers.file_table` where the caller has it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    table = H.file_table(spark, paths, encoding) if table is None else table
    return read_found(table, H.refuse(H.headers(table, sep), required or []), paths, encoding)


def read_found(table: DataFrame, found: list[H.Header], paths: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The rows of the files of some headers of a table of files.

    With ``paths``, ``found`` are all headers, and a path with one of them is read as a whole; other files are read by name."""
    spark, out = table.sparkSession, None
    if not found:
        raise ValueError("no files with a header")
    sources = [h.source_no for h in found]
    for h in found:
        if paths and sources.count(h.source_no) == 1:
            names: str | list[str] = paths[h.source_no]
        else:
            same = table.where((F.col("source_no") == h.source_no) & (F.col("header") == h.line))
            names = sorted(r["path"] for r in same.select("path").collect())
        df = read_columns(spark, names, h, encoding)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_columns(spark: SparkSession, names: str | list[str], header: H.Header, encoding: str) -> DataFrame:
    """The rows of files that have one header, every column as text. Columns go by place, so no file is opened to learn their names."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header.written))])
    raw = spark.read.schema(schema).option("header", True).option("sep", header.sep).option("encoding", encoding).csv(names)
    return raw.select(
        *[F.col(f"c{i}").alias(n) for n, i in header.places.items()],
        F.col("_metadata.file_name").alias("source_file"),
        F.lit(header.source_no).alias("source_no"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("row_block"),
        F.monotonically_increasing_id().alias("row_seq"),
    )


# The order of rows as the files were given, within a day.
FILE_ORDER = ["source_no", "source_path", "row_block", "row_seq"]


def ranked_sources(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """``rows``, which are written, with the rank of their source path in place of path and name in ``order``: numbers are cheaper to compare and to send.

    There is one row for each file in what is ranked and sent to all tasks."""
    if "source_path" not in order:
        return rows, order
    ranks = rows.select("source_path").distinct().withColumn("source_rank", F.row_number().over(Window.orderBy("source_path")))
    ranked = rows.join(F.broadcast(ranks), "source_path", "left")
    return ranked, ["source_rank" if c == "source_path" else c for c in order if c != "source_file"]


def read_ledger(spark: SparkSession, paths: list[str], sep: str = ",", encoding: str = "UTF-8", table: DataFrame | None = None) -> DataFrame:
    """Several ledger files as one table; headers may differ in order and in optional columns, but each has the required ones."""
    if not paths:
        raise ValueError("no files given")
    return read_text_csv(spark, paths, sep, encoding, required=S.REQUIRED, table=table)


def read_legacy(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", sep: str = ";", table: DataFrame | None = None) -> DataFrame:
    """Older ledger: ``;`` between fields and a decimal comma."""
    df = read_text_csv(spark, path, sep, encoding, required=S.LEGACY_REQUIRED, table=table)
    numeric = {c for c, n in S.LEGACY_NAMES.items() if n in S.NUMERIC}
    return df.select(*[to_number(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def read_tenant_csv(spark: SparkSession, path: str | list[str], layout: CsvLayout) -> DataFrame:
    """A tenant's file under our names, following its stored layout."""
    df = read_text_csv(spark, path, layout.sep, layout.encoding, required=list(layout.mapping))
    return df.withColumnsRenamed(layout.mapping)


def read_erp_report(spark: SparkSession, path: str | list[str], names: list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """ERP report: a period line and a header above the rows, repeated header names, ``;`` between fields.

    Columns are named by position, which settles repeated names; lines whose first field is blank, or is
    the word that heads the column, or states the period, are not data. A code that only begins like them is data.
    """
    raw = (
        spark.read.schema(S.text_schema(names))
        .option("header", False).option("sep", ";").option("encoding", encoding).option("mode", "PERMISSIVE")
        .csv(path)
    )
    first = strip(names[0])
    heading = first.rlike(r"(?i)^(c[oó]digo|per[ií]odo\s*:.*|per[ií]odo)$")
    return raw.where((first != "") & ~heading).withColumn(names[0], F.btrim(first, F.lit("'")))


def guard_tenant(path: str, root: str, org_id: str) -> str:
    """``path`` if it lies in the tenant's folder; refuses anything else, parent references included."""
    rest = path[len(root.rstrip("/")) + 1 :] if path.startswith(root.rstrip("/") + "/") else ""
    parts = rest.split("/")
    if not parts or parts[0] != org_id or ".." in parts:
        raise PermissionError(f"{path} is not in the folder of {org_id}")
    return path


def load_years(
    spark: SparkSession, root: str, org_id: str, years: list[int], *, prefix: str = "raw", sep: str = ",", schema: str | T.StructType | None = None
) -> tuple[dict[int, DataFrame], list[int]]:
    """Register ``data_{year}`` for every yearly file of a tenant; also returns the years not found.

    With a ``schema`` a file whose header differs from it fails, and no file is read beforehand; without one, types
    are inferred, which reads every file once more."""
    found, absent = {}, []
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema).option("enforceSchema", False) if schema else reader.option("inferSchema", True)
    for y in years:
        path = guard_tenant(f"{root.rstrip('/')}/{org_id}/{prefix}/data_{y}.csv", root, org_id)
        try:
            found[y] = reader.csv(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            absent.append(y)
        else:
            found[y].createOrReplaceTempView(f"data_{y}")
    return found, absent


def read_parquet(spark: SparkSession, path: str, org_id: str) -> DataFrame:
    """One organization's rows; the organization is never optional."""
    return spark.read.parquet(path).where(F.col("org_id") == org_id)


def read_parquet_all(spark: SparkSession, path: str) -> DataFrame:
    """All rows, whoever they belong to: for tables without organizations and for administration."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    if by:
        grouped_for(df, *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(
    df: DataFrame, path: str, sep: str = ",", decimal: str = ".", encoding: str = "UTF-8", *, mode: str = "overwrite", compression: str | None = None
) -> None:
    """CSV part files with a header; a decimal comma on request. All readers take compressed files by their names, each in one task."""
    if decimal != ".":
        swap = lambda f: F.regexp_replace(F.col(f.name).cast("string"), r"\.", decimal).alias(f.name)
        df = df.select(*[swap(f) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])
    (
        df.write.mode(mode).option("header", True).option("sep", sep).option("encoding", encoding)
        # Level four packs nearly as well as the usual one and takes half its time.
        .option("compression", compression or "none").option("zlib.compress.level", "FOUR")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def split_by_year(df: DataFrame, path: str, date: str = "date", fmt: str = "parquet") -> None:
    """One folder per calendar year."""
    w = grouped_for(df.withColumn("year", F.year(date)), "year").write.mode("overwrite").partitionBy("year")
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(path)


def number_parts(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Cut the ordered rows into ``n`` near-equal parts at rows floor(k * total / n)."""
    ranked = in_order(df, keys=[], order=order, values={"__row": F.lit(1)})
    # Row r (from 1) lies in the last part whose first row floor(k * total / n) is below r.
    part = F.expr(f"(cast(__row as bigint) * {n} - 1) div cast(__row_total as bigint)")
    return ranked.withColumn("part", part.cast("int")).drop("__row", "__row_total")


def split_in_parts(df: DataFrame, path: str, n: int, order: list[Column]) -> None:
    number_parts(df, n, order).write.mode("overwrite").partitionBy("part").parquet(path)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` laid out as org/type/name: key, size and time, newest first. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    )
    # The root as Spark qualifies it is a literal prefix of every path, whatever its last name repeats.
    place = r"^[a-z0-9]+:(//[^/]*)?/*"
    base = re.sub(place, "", root.rstrip("/")).lstrip("/") + "/"
    rel = F.substr(F.regexp_replace("path", place, ""), F.lit(len(base) + 1))
    bits = F.split(rel, "/")
    return files.select(
        rel.alias("file_key"),
        bits[0].alias("org_id"),
        F.when(F.size(bits) > 2, bits[1]).otherwise(F.lit("")).alias("file_type"),
        "size_bytes",
        "modified_at",
    ).orderBy(F.desc("modified_at"), "file_key")


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("org_id", "file_type").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"), F.max("modified_at").alias("newest")
    )
