"""Exact percentiles of whole columns without holding a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.functions.ordered import in_order


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (column, value) per non-null number."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_percentiles(df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 20_000) -> DataFrame:
    """(column, p, value) with linear interpolation between neighbours.

    Pass 1 brackets each percentile by approximate ones, or by the extremes at the ends. Pass 2 counts the rows below
    each bracket by sums, and lists only the values inside one (a few 1/accuracy parts of the rows), each with its
    number. Those are ranked by blocks of their order, and each block looks for the ranks asked for by itself, so no task holds
    a bracket. If a bracket ever missed its rank the job fails rather than return a wrong number.
    """
    eps = 8.0 / accuracy
    cuts = sorted({max(0.0, p - eps) for p in probs} | {min(1.0, p + eps) for p in probs})
    at = {c: i for i, c in enumerate(cuts)}
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    aggs: list[Column] = []
    for c in columns:
        v = number(c)
        aggs += [
            F.count(v).alias(f"n_{c}"),
            F.percentile_approx(v, [float(x) for x in cuts], accuracy).alias(f"q_{c}"),
            F.min(v).alias(f"lo_{c}"),
            F.max(v).alias(f"hi_{c}"),
        ]
    ends = df.agg(*aggs).first()  # one row of 2 * len(probs) + 3 numbers a column
    brackets = []
    for c in columns:
        n, q, low, high = ends[f"n_{c}"], ends[f"q_{c}"], ends[f"lo_{c}"], ends[f"hi_{c}"]
        for p in probs if n else []:
            # The bracket is eps * n ranks wide on either side; where that is less than two ranks it is the column.
            wide = eps * n >= 2
            lo = q[at[p - eps]] if wide and p - eps > 0 else low
            hi = q[at[p + eps]] if wide and p + eps < 1 else high
            brackets.append((c, float(p), n, lo, hi))
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, p double, value double")
    if not brackets:
        return empty
    below = [F.count_if(number(c) < F.lit(lo)).alias(f"b{i}") for i, (c, _, _, lo, _) in enumerate(brackets)]
    under = df.agg(*below).first()
    inside = F.array_compact(
        F.array(*[F.when(number(c).between(lo, hi), F.struct(F.lit(i).alias("bracket"), number(c).alias("v"))) for i, (c, _, _, lo, hi) in enumerate(brackets)])
    )
    counted = df.select(F.inline(inside)).groupBy("bracket", "v").agg(F.count("*").alias("cnt"))
    ranked = in_order(counted, keys=["bracket"], order=[F.col("v")], values={"upto": F.col("cnt")})
    known = spark.createDataFrame([(i, c, p, n, under[i]) for i, (c, p, n, _, _) in enumerate(brackets)], "bracket int, column string, p double, n long, under long")
    pos = (F.col("n") - 1) * F.col("p")
    upto = F.col("under") + F.col("upto")
    holds = lambda k: (upto - F.col("cnt") <= k) & (k < upto)
    # One row for each bracket is broadcast to the ranked values, which are added up where they lie; then as many rows meet.
    found = (
        ranked.join(F.broadcast(known), "bracket")
        .groupBy("bracket")
        .agg(F.max(F.when(holds(F.floor(pos)), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil(pos)), F.col("v"))).alias("b"))
    )
    picked = known.join(F.broadcast(found), "bracket", "left")
    missed = F.col("a").isNull() | F.col("b").isNull()
    value = F.when(missed, F.raise_error(F.lit("percentile bracket missed its rank")).cast("double")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * (pos - F.floor(pos))
    )
    return picked.select("column", "p", value.alias("value"))


def stats_by_column(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row per column: n, mean, std, min, max and a percentile per entry of ``probs`` (named p25, p50, ...)."""
    basic = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])))
    names = {p: f"p{round(p * 100)}" for p in probs}
    q = exact_percentiles(df, columns, probs)
    q = q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return basic.select("column", "s.*").join(q, "column", "left")
