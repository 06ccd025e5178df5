"""The table of input files: their header lines, read by the executors in one job, and what each file lacks.

Nothing here reads more of a file than its first line, and nothing per file passes through the driver: it sees one
row for each different header of each given path.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandry.session import materialize

# A header line is looked for in this much of a file, read in pieces.
HEADER_BYTES, PIECE = 1 << 20, 1 << 14

LISTED = "path string, modificationTime timestamp, length long, content binary"
SCHEME = r"^[A-Za-z0-9]+:(//[^/]*)?/*"


class MissingColumns(ValueError):
    """A ledger lacks required columns."""


def plain_path(path: str) -> str:
    """A path without scheme, host and doubled or closing slashes."""
    return re.sub(r"/+", "/", "/" + re.sub(SCHEME, "", path)).rstrip("/") or "/"


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_no (place of the given path), path and size_bytes of every file under the paths; contents are not read.

    Paths with wildcards are listed one by one, all others together: a file belongs to each given path that is the
    file itself or a folder above it.
    """
    listing = lambda p: spark.read.schema(LISTED).format("binaryFile").load(p)
    wild = [(i, p) for i, p in enumerate(paths) if re.search(r"[*?\[{]", p)]
    plain = [(i, p) for i, p in enumerate(paths) if not re.search(r"[*?\[{]", p)]
    parts = [listing(p).select(F.lit(i).alias("source_no"), "path", F.col("length").alias("size_bytes")) for i, p in wild]
    if plain:
        found = listing(sorted({p for _, p in plain})).select("path", F.col("length").alias("size_bytes")).distinct()
        given = spark.createDataFrame([(i, plain_path(p)) for i, p in plain], "source_no int, place string")
        names = F.split(F.regexp_replace("path", SCHEME, ""), "/+")
        above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(names, 1, k), "/")))
        parts.append(found.withColumn("place", F.explode(above)).join(given, "place").select("source_no", "path", "size_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_first_line(p, e) for p, e in zip(batch.column("path").to_pylist(), batch.column("encoding").to_pylist())]
        arrays = [*batch.columns, pa.array([line for line, _ in found], pa.string()), pa.array([ok for _, ok in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "header", "reached"])


def _first_line(path: str, encoding: str) -> tuple[str | None, bool]:
    """The first line of a file that is not blank, and whether the file's store can be reached without Spark."""
    try:
        fs, local = _store(path)
        with fs.open_input_stream(local) as f:
            return _line_of(f, encoding), True
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None, False


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        return pa.fs.LocalFileSystem(), "/" + re.sub(SCHEME, "", path)
    return pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _line_of(f: pa.NativeFile, encoding: str) -> str | None:
    data, more = b"", True
    while more:
        part = f.read(PIECE)
        data, more = data + part, len(part) == PIECE and len(data) < HEADER_BYTES
        lines = [x for x in re.split("\r\n|\n|\r", data.decode(encoding, "replace").replace("\ufeff", "")) if x.strip()]
        if len(lines) > 1 or (lines and not more):
            return lines[0]
    return None


def file_table(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """source_no, path, size_bytes, encoding and header (null: no line) of all files, written once to the shared folder.

    The executors read the first lines themselves. Of files in a store that only Spark reaches, Spark reads the first line:
    a scan of one row for each such file.
    """
    return with_headers(list_files(spark, paths).withColumn("encoding", F.lit(encoding)))


def with_headers(listed: DataFrame) -> DataFrame:
    """``listed`` (path, encoding and more) with header, written once."""
    spark = listed.sparkSession
    spread = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = T.StructType([*spread.schema.fields, T.StructField("header", T.StringType()), T.StructField("reached", T.BooleanType())])
    table = materialize(spread.mapInArrow(_first_lines, schema), "files")
    far = [r["path"] for r in table.where(~F.col("reached")).select("path").distinct().collect()]
    if far:
        # By a hundred files a job, each of which reads one row of a file.
        parts = []
        for k in range(0, len(far), 100):
            one = [
                spark.read.text(p).where(F.length(F.btrim("value")) > 0).limit(1).select(F.lit(p).alias("path"), F.col("value").alias("line"))
                for p in far[k : k + 100]
            ]
            parts.append(materialize(reduce(DataFrame.unionAll, one), "headers"))
        table = table.join(reduce(DataFrame.unionAll, parts), "path", "left").withColumn("header", F.coalesce("header", "line")).drop("line")
    return table.drop("reached")


def blank_name(written: str) -> bool:
    """Whether a header names nothing: blank, or the name that other tools give to a blank one."""
    return not written.strip() or written.strip().lower().startswith("unnamed")


@dataclass(frozen=True)
class Header:
    """One header line below one given path: how many files have it, the first of them, and its columns in order."""

    source_no: int
    line: str
    sep: str
    n_files: int
    first: str

    @property
    def written(self) -> list[str]:
        return next(csv.reader([self.line], delimiter=self.sep), [])

    @property
    def places(self) -> dict[str, int]:
        """Column name -> place. Columns without a name are left out; names that repeat have their place behind them."""
        names = [w.strip() for w in self.written]
        low = [n.lower() for n in names]
        return {n if low.count(n.lower()) == 1 else f"{n}{i}": i for i, n in enumerate(names) if not blank_name(n)}

    def missing(self, required: list[str]) -> list[str]:
        return [c for c in required if c not in self.places]


def headers(table: DataFrame, sep: str = ",") -> list[Header]:
    """The different headers of a table of files: one row for each header and given path."""
    found = table.where(F.col("header").isNotNull()).groupBy("source_no", "header").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return [Header(r["source_no"], r["header"], sep, r["n"], r["path"]) for r in sorted(found.collect())]


def refuse(found: list[Header], required: list[str]) -> list[Header]:
    """``found``, or an error naming the files that lack required columns, what they lack and what they have."""
    bad = [(h, h.missing(required)) for h in found if h.missing(required)]
    if bad:
        told = []
        for h, missing in bad:
            names = h.first.rsplit("/", 1)[-1] + (f" and {h.n_files - 1} more" if h.n_files > 1 else "")
            told.append(f"{names}: missing columns {missing}; found {list(h.places)}")
        raise MissingColumns("; ".join(told))
    return found


# Verdicts on a file.
GOOD, LACKING, NO_LAYOUT, EMPTY = "good", "missing columns", "no layout", "empty"


def judged(table: DataFrame, found: list[Header], required: list[str]) -> DataFrame:
    """The table of files with missing (columns) and verdict. A file without any line is empty, and holds no rows to lose."""
    lacks = table.sparkSession.createDataFrame(
        [(h.source_no, h.line, h.missing(required)) for h in found], "source_no int, header string, missing array<string>"
    )
    return with_verdict(table.join(lacks, ["source_no", "header"], "left"))


def with_verdict(files: DataFrame) -> DataFrame:
    verdict = F.when(F.col("header").isNull(), F.lit(EMPTY)).when(F.size("missing") > 0, F.lit(LACKING)).otherwise(F.lit(GOOD))
    return files.withColumn("verdict", verdict)


def data_lines(files: DataFrame) -> DataFrame:
    """``files`` (path and more) with n_lines, the lines below the header that are not blank: the rows a refused file holds back.

    The files are read where they lie, in pieces.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("n_lines", T.LongType())])
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_count_lines, schema)


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path in batch.column("path").to_pylist():
            fs, local = _store(path)
            n, open_line = 0, False
            with fs.open_input_stream(local) as f:
                while part := f.read(HEADER_BYTES):
                    lines = re.split(b"[\r\n]+", part)
                    filled = [bool(x.strip()) for x in lines]
                    n += sum(filled) - (open_line and filled[0])
                    open_line = filled[-1] if len(lines) > 1 else open_line or filled[-1]
            counts.append(max(0, n - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_lines"])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; planning a read lists it, and runs no job."""
    try:
        spark.read.format("binaryFile").schema(LISTED).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
