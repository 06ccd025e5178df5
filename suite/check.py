"""Run queries against their SQL twins: ``python -m suite.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

from suite import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _text(v: object) -> str:
    """One spelling per value, whichever engine it came from."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)[:10] if hasattr(v, "year") else str(v)


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(_text)
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def _family(t: str) -> str:
    t = t.lower()
    if t.startswith("varchar"):
        return "string"
    return t


def compare(spark, con, name: str, sf: str) -> str:
    df = QUERIES[name](spark, sf)
    got = df.toPandas()
    if name not in ORACLE:
        return f"rows {len(got)} (no SQL)"
    rel = con.sql(ORACLE[name])
    types = dict(zip(rel.columns, [_family(str(t)) for t in rel.types]))
    want = rel.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} / {sorted(want.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    alias = {"int": "integer"}
    off = {c: (spark_types[c], types[c]) for c in types if alias.get(spark_types[c], spark_types[c]) != types[c]}
    a, b = _plain(got), _plain(want)
    note = f" TYPES {off}" if off else ""
    if len(a) != len(b):
        return f"FAIL rows {len(a)} / {len(b)}{note}"
    if a.equals(b):
        return f"ok {len(a)} rows{note}"
    bad = (a != b).any(axis=1)
    i = bad.idxmax()
    cols = [c for c in a.columns if a.at[i, c] != b.at[i, c]]
    return f"FAIL {int(bad.sum())}/{len(a)} rows differ, first in {cols}: {a.loc[i].to_dict()} / {b.loc[i].to_dict()}{note}"


def main(argv: list[str]) -> int:
    from demandry.session import build

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf), 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            res = "FAIL " + "".join(traceback.format_exception_only(e))[:900]
        failed += res.startswith("FAIL")
        print(f"{n:38s} {time.time() - t:6.2f}s  {res}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
