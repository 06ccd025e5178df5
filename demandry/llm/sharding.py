"""Shards by rendezvous hashing of record keys, with weights.

Each pair of key and shard has a fixed pseudo-random number u in (0, 1); a record goes to the shard with the
least ``-ln(u) / weight``. Shard s then gets a share of the keys in proportion to its weight, whatever the keys,
and a new shard takes over only those records for which its own value is the least: all others stay.

Every record is placed by itself, without a shuffle. Only the numbering inside the shards shuffles, and only
key, size and checksum, never the text; no shard is ever gathered in one task.

* null text: size and checksum of the empty text. Null key: hashed as the word ``null``.
* Repeated rows each get a slot of their own; equal keys share the shard.
* Empty table: no rows. Other columns of the input are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.functions.ordered import in_order

# u = (13 hex digits of md5 + 1) / (2^52 + 1): both parts are whole numbers that a double holds.
_DIGITS, _SPAN = 13, float(2**52 + 1)


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight of a key in a shard."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + F.lit(1.0)) / F.lit(_SPAN)
    return -F.log(u) / weight


def place(df: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """``df`` with ``shard`` among ``len(weights)`` and ``grown_shard``, its shard once one more is added."""
    if not weights or min(*weights, new_weight) <= 0:
        raise ValueError("weights are above zero, one for each shard")
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    costs = F.transform(at, lambda s: F.struct(cost(F.col(key), s["i"], s["w"]).alias("cost"), s["i"].alias("shard")))
    new = cost(F.col(key), F.lit(len(weights)), F.lit(float(new_weight)))
    return (
        df.withColumn("__best", F.array_min(costs))  # of equal costs, the lower shard
        .withColumn("__new", new)
        .withColumn("shard", F.col("__best.shard"))
        .withColumn("grown_shard", F.when(F.col("__new") < F.col("__best.cost"), F.lit(len(weights))).otherwise(F.col("shard")))
        .drop("__best", "__new")
    )


def shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", extra_bytes: int = 16) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard and slot (from 0 in each shard, without gaps, by key)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key), (F.octet_length(body) + F.lit(extra_bytes)).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    placed = place(rows, key, weights)
    numbered = in_order(
        placed, keys=["shard"], order=[F.col(key), F.col("text_crc32"), F.col("size")], values={"__slot": F.lit(1)}
    )
    return numbered.withColumn("slot", F.col("__slot").cast("long") - 1).drop("__slot", "__slot_total")
