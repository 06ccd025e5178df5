"""A Merkle tree over the rows of a dataset: one tree for each group of rows, and one over the groups' roots.

A leaf is the SHA-256 of a row's fields. Leaves stand in order of their keys; every eight neighbouring nodes have one parent,
the digest of their hex digests in order, and so on until one node remains. The tree is kept in aligned blocks of 512
nodes. A block holds each of its levels as one string of hex digests of fixed width: parents are digests of substrings,
and the substrings to the left and right of a node in its run are the siblings of its proof. The roots of the blocks are the nodes of the next
blocks, and so on: one round for each factor of 512. The groups' roots make a last tree in the same way.

Texts are read once, hashed where they lie and never shuffled. Leaves are ordered by ranges of (group, key, digest,
row), so a group of any size, one key and even equal rows are dealt over many tasks; blocks have at most 512 rows. Nothing is
broadcast by us, and the driver gets one number a round.

* A null field is ``-``, other than the empty text ``0:``. A null group is a group, and the first one. Null keys come first.
* Rows of equal keys are in the order of their digests; equal rows are leaves each.
* An empty table has no leaves, no groups and no root. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.functions.ordered import in_order
from demandry.session import materialize

FAN, HEX, ROUND = 8, 64, 3
BLOCK, RUN = FAN**ROUND, FAN * HEX
PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, each with its length, so that no two rows of fields read alike."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return digest(F.concat(*[one(c) for c in fields]))


def _cut(level: Column, start: Column | int, size: Column | int) -> Column:
    """Part of a string of hex digits, from 0. By bytes, so that a part is found without reading what is before."""
    whole = lambda x: F.lit(x) if isinstance(x, int) else x.cast("int")
    return F.substring(level.cast("binary"), whole(start) + 1, whole(size)).cast("string")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / F.lit(RUN)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda r: digest(_cut(level, r * RUN, RUN))), "")


def _segment(level: Column, node: Column) -> Column:
    """What is left and right of a node in its run."""
    run = F.floor(node / F.lit(FAN)) * RUN
    before = (node % FAN) * HEX
    return F.struct(_cut(level, run, before).alias("left"), _cut(level, run + before + HEX, F.lit(RUN - HEX) - before).alias("right"))


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """group, block, n (nodes of the group), rows (what the nodes carry, in order), level0 to level3, rise and top.

    ``rise`` levels have parents: three, or fewer where the group ends in this block.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "digest", F.struct(F.lit(0).alias("__"), *carry).alias("kept"))))
    held = nodes.groupBy("group", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).agg(F.first("n").alias("n"), rows.alias("nodes"))
    rise = F.lit(0)
    for r in range(ROUND):
        rise = F.when(F.col("n") > FAN**r, F.lit(r + 1)).otherwise(rise)
    out = held.select("group", "block", "n", rise.alias("rise"), F.col("nodes.kept").alias("rows"), F.array_join("nodes.digest", "").alias("level0"))
    for r in range(ROUND):
        out = out.withColumn(f"level{r + 1}", F.when(F.col("rise") > r, _parents(F.col(f"level{r}"))))
    tops = [F.when(F.col("rise") == r, F.col(f"level{r}")) for r in range(ROUND + 1)]
    return materialize(out.withColumn("top", F.coalesce(*tops)), "tree")


def _climb(nodes: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of the nodes, and for each block (group, block) the path from its top to the root of its group."""
    blocks = _blocks(nodes, carry)
    done = blocks.where(F.col("n") <= BLOCK).select("group", "block", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    most = blocks.agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= BLOCK:
        return blocks, done
    above = blocks.where(F.col("n") > BLOCK).select(
        "group", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(BLOCK)).alias("n"), F.col("top").alias("digest")
    )
    upper = _paths(*_climb(above, ["pos"]), ["pos"])
    return blocks, done.unionByName(upper.select("group", F.col("pos").alias("block"), "path", "root"))


def _paths(blocks: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """group, carried columns, digest, path and root of each node."""
    place = lambda r, i: F.floor(i / F.lit(FAN**r)).cast("int")
    own = lambda i: F.slice(F.array(*[_segment(F.col(f"level{r}"), place(r, i)) for r in range(ROUND)]), F.lit(1), F.col("rise"))
    node = lambda x, i: F.struct(x.alias("kept"), _cut(F.col("level0"), i * HEX, HEX).alias("digest"), own(i).alias("own"))
    each = blocks.select("group", "block", F.inline(F.transform("rows", node)))
    joined = each.join(above, ["group", "block"])
    return joined.select("group", *[F.col(f"kept.{c}").alias(c) for c in carry], "digest", F.concat("own", "path").alias("path"), "root")


def proofs(leaves: DataFrame, key: str, group: str, digest_column: str, carry: list[str] | None = None) -> DataFrame:
    """key, group, carried columns, leaf, subroot, root, and path: left and right siblings of each level, lowest first.

    ``leaves`` has a row for each leaf with its digest. The path leads through the group's root to the root of all.
    """
    kept = ["key", *[f"c{i}" for i in range(len(carry or []))]]
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("group"),
        F.col(digest_column).alias("digest"),
        F.col(key).alias("key"),
        *[F.col(c).alias(k) for c, k in zip(carry or [], kept[1:])],
        F.monotonically_increasing_id().alias("row"),
    )
    placed = in_order(rows, keys=["group"], order=[F.col("key"), F.col("digest"), F.col("row")], values={"pos": F.lit(1)})
    nodes = placed.select("group", "digest", *kept, (F.col("pos").cast("long") - 1).alias("pos"), F.col("pos_total").cast("long").alias("n"))
    blocks, above = _climb(nodes, kept)
    above = materialize(above, "paths")
    # One row for each group, numbered like the leaves, under one group of its own.
    roots = above.where(F.col("block") == 0).select(F.lit("").alias("all"), F.col("group").alias("of"), F.col("root").alias("digest"))
    ranked = in_order(roots, keys=["all"], order=[F.col("of")], values={"pos": F.lit(1)})
    tops = ranked.select(F.col("all").alias("group"), "of", "digest", (F.col("pos").cast("long") - 1).alias("pos"), F.col("pos_total").cast("long").alias("n"))
    last = _paths(*_climb(tops, ["of"]), ["of"]).select(F.col("of").alias("group"), F.col("path").alias("to_root"), F.col("root").alias("of_all"))
    full = above.join(materialize(last, "paths"), "group").select(
        "group", "block", F.concat("path", "to_root").alias("path"), F.struct(F.col("root").alias("subroot"), F.col("of_all").alias("root")).alias("root")
    )
    names = [F.col(k).alias(c) for c, k in zip(carry or [], kept[1:])]
    return _paths(blocks, full, kept).select(
        F.col("key").alias(key), F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias(group), *names,
        F.col("digest").alias("leaf"), F.col("root.subroot").alias("subroot"), F.col("root.root").alias("root"), "path",
    )


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to: the root of all if, and only if, the row is as it was."""
    return F.aggregate(path, leaf_digest, lambda below, s: digest(F.concat(s["left"], below, s["right"])))
