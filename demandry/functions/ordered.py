"""Running sums and ranks over orders that may be far larger than one task.

A window keyed by a product (or by nothing) would put a hot product's whole history into one task.
Both functions below cut such orders into blocks, add up block totals, and only run windows inside a
block, so no task sees more than one block of rows, or one key of as many at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.session import materialize


def running_balance(
    df: DataFrame, value: Column, *, keys: list[str], coarse: str, fine: list[str], order: list[str], out: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in the order (coarse, fine..., order...).

    ``coarse`` has few values per key (months); ``fine`` are order-compatible blocks inside it that
    are bounded by construction (a day and a block of row numbers). Rows are shuffled once, by key and ``coarse``; a month
    of a key with more than ``hot_rows`` rows is cut into its blocks instead, so that no task holds it.
    Rows without a key, month or block have no place in the order and are left out.
    """
    block, group = [*keys, coarse, *fine], [*keys, coarse]
    for c in block:
        df = df.where(F.col(c).isNotNull())
    # One row per key and month, written once: read for the sums before each month and for the hot ones.
    sums = materialize(df.groupBy(*group).agg(F.sum(value).alias("__sum"), F.count("*").alias("__n")), "sums")
    upto = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, F.coalesce(F.sum("__sum").over(upto(keys, [coarse])), F.lit(0.0)).alias("__base"))
    hot = sums.where(F.col("__n") > hot_rows).select(*group)
    if hot.isEmpty():
        return _within_months(df, value, base, group, fine, order, out)
    # At most rows / hot_rows of them.
    mine = df.join(F.broadcast(hot), group, "left_semi")
    rest = df.join(F.broadcast(hot), group, "left_anti")
    return _within_months(rest, value, base, group, fine, order, out).unionByName(_by_blocks(mine, value, base, group, fine, order, out))


def running_balance_by_key(
    df: DataFrame, value: Column, *, keys: list[str], coarse: str, fine: list[str], order: list[str], out: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """:func:`running_balance` for wide rows: these are shuffled once, by key alone, and no sums of months are.

    Only a key with more than ``hot_rows`` rows is cut into its months."""
    for c in (*keys, coarse, *fine):
        df = df.where(F.col(c).isNotNull())
    hot = _hot_keys(df, keys, hot_rows)
    if hot is None:
        return _within_keys(df, value, keys, [coarse, *fine], order, out)
    # At most rows / hot_rows of them.
    mine = df.join(F.broadcast(hot), keys, "left_semi")
    rest = df.join(F.broadcast(hot), keys, "left_anti")
    cut = running_balance(mine, value, keys=keys, coarse=coarse, fine=fine, order=order, out=out, hot_rows=hot_rows)
    return _within_keys(rest, value, keys, [coarse, *fine], order, out).unionByName(cut)


# Rows are counted in so many groups of keys before any key is counted by itself.
_SLOTS = 1 << 16


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, or nothing. Keys are counted by groups, and one by one only in groups with so many rows."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS)).alias("__slot")
    full = materialize(df.groupBy(slot).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("__slot"), "slots")
    if full.isEmpty():
        return None
    suspects = df.select(*keys, slot).join(F.broadcast(full), "__slot", "left_semi")
    hot = materialize(suspects.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*keys), "hot")
    return None if hot.isEmpty() else hot


def _within_keys(df: DataFrame, value: Column, keys: list[str], blocks: list[str], order: list[str], out: str) -> DataFrame:
    run = lambda part, by: F.sum(value).over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    # A row before the first value of its block has no sum. Both windows stand on one sort.
    known = run([*keys, *blocks], order).isNotNull()
    return df.withColumn(out, F.when(known, run(keys, [*blocks, *order])))


def _within_months(df: DataFrame, value: Column, base: DataFrame, group: list[str], fine: list[str], order: list[str], out: str) -> DataFrame:
    run = lambda part, by: F.sum(value).over(Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    # A row before the first value of its block has no sum. Both windows stand on one sort.
    known = run([*group, *fine], order).isNotNull()
    summed = df.withColumn("__run", F.when(known, run(group, [*fine, *order]))).join(base, group)
    return summed.withColumn(out, F.col("__base") + F.col("__run")).drop("__base", "__run")


def _by_blocks(df: DataFrame, value: Column, base: DataFrame, group: list[str], fine: list[str], order: list[str], out: str) -> DataFrame:
    block = [*group, *fine]
    before = Window.partitionBy(*group).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*block).agg(F.sum(value).alias("__sum"))
        .select(*block, F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__off"))
        .join(base, group)
        .select(*block, (F.col("__off") + F.col("__base")).alias("__before"))
    )
    inside = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("__run", F.sum(value).over(inside))
        .join(offsets, block)
        .withColumn(out, F.col("__before") + F.col("__run"))
        .drop("__before", "__run")
    )


def in_order(df: DataFrame, *, keys: list[str], order: list[Column], values: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """Running sums per ``keys`` along ``order``, for orders without natural blocks.

    For each ``name -> value`` adds ``name`` (running sum, this row included) and ``name_total``.
    Rows are range-partitioned on the full order, so equal or hot values are split as well; the block
    number is written with the rows, which keeps it fixed for the two later uses.
    """
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = df.select("*", *[v.cast("double").alias(f"__v_{k}") for k, v in values.items()])
    placed = materialize(
        held.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__block", F.spark_partition_id()), "ordered"
    )
    # One row per key and block: at most keys + blocks rows.
    sums = placed.groupBy(*keys, "__block").agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(
        *keys,
        "__block",
        *[F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0.0)).alias(f"__b_{k}") for k in values],
        *[F.sum(f"__s_{k}").over(whole).alias(f"{k}_total") for k in values],
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.select("*", *[F.sum(f"__v_{k}").over(inside).alias(f"__r_{k}") for k in values]).join(sums, [*keys, "__block"])
    for k in values:
        out = out.withColumn(k, F.col(f"__b_{k}") + F.col(f"__r_{k}"))
    return out.drop("__block", *[f"__{p}_{k}" for p in "vbr" for k in values])


def with_group_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, spread: Column, hot_rows: int = 1_000_000) -> DataFrame:
    """Left join of group totals back to their rows, whatever the size of a group.

    ``size`` is the row count of a group in ``totals``. Totals of groups above ``hot_rows`` rows are broadcast:
    there are at most rows / hot_rows of them. Their rows are then dealt over many tasks by ``spread`` instead of
    meeting in one; all other rows meet their totals in a shuffle.
    """
    values = [c for c in totals.columns if c not in keys and c != size]
    parts = F.floor(F.col(size) / F.lit(hot_rows)).cast("int")
    hot = totals.where(F.col(size) > hot_rows).select(*keys, parts.alias("__parts"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    cold = totals.where(F.col(size) <= hot_rows).select(*keys, F.lit(0).alias("__part"), *values)
    dealt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int") + 1)
    tagged = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", dealt)
    return (
        tagged.join(cold, [*keys, "__part"], "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"__hot_{c}")) for c in values})
        .drop("__part", "__parts", *[f"__hot_{c}" for c in values])
    )
