"""Documents whose sets of word shingles are alike: an exact Jaccard join, heavy and light.

Equal texts and equal sets are joined by digest first; from there on a node is a different set. How many different
texts of the corpus have a shingle (see blocks) orders each set from rare to common.

* **Light** sets, up to a boundary, list their subsets of just the size that a partner would have to share: two sets
  that share such a subset are linked. Of all sets with one subset, each is tied to the smallest, which links the
  same components with one row per set.
* **Heavy** sets meet in the inverted lists of their rarest shingles (as many as any linked pair must share one of;
  shingles that occur once have no list). A meeting counts only if sizes, the places of the shingle in both orders,
  and the parities of shingle counts in 256 hashed buckets allow a link; a list's entries have one width, whatever the set's
  size. Then the parities in as many buckets as the sets are large are looked up, and what they allow is compared. First all sets of a
  list meet its least edited one only, and what is connected by then needs no more meetings; then the rest meet.
* The **boundary** is where the number of subsets to list and of list entries to scan is the least in sum, both
  counted from the data.

The result is exact but for the equality of 64-bit hashes of shingles.

* Null, empty and blank texts have no set and are linked with nothing; each is a component of its own.
* Repeated rows are one component. Null keys count as the least key, and a component with one has a null id.
* Only key and text are looked at, so other columns can't clash. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.llm import blocks as B
from demandry.llm.components import roots, tightened
from demandry.session import materialize

SHINGLE = 3
PERCENT = 90
_LEADS = -1  # marks what says which rows stand for their text, among the answers to a block
EARLY_ROUNDS = 2  # after the first links; more would spare a few meetings and cost a join each
MOST_LIGHT = 40  # no boundary above this: subsets of large sets are too many
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

# Parities that go with a set into every list: FOLD longs of bits.
FOLD = 4
_FOLD = [f"f{i}" for i in range(FOLD)]

_SETS = (
    "key long, no_key boolean, digest binary, n int, node binary, lead boolean, prefix array<struct<t:long,p:int>>, "
    f"{', '.join(f'{f} long' for f in _FOLD)}, parity array<long>, members binary"
)


@dataclass(frozen=True)
class Threshold:
    """Sizes that a Jaccard similarity of ``percent`` per cent or more implies, in whole numbers."""

    percent: int = PERCENT

    def overlap(self, n: int, m: int) -> int:
        """Least overlap of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def probe(self, n):
        """Shingles of a set, from rare to common, of which any smaller or equal partner has one."""
        return n - -(-self.percent * n // 100) + 1

    def listed(self, n):
        """The same for partners at least as large."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def partners(self, n: int) -> range:
        """Sizes of possible partners."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def shared(self, n: int, boundary: int) -> list[int]:
        """Sizes of the subsets that a set of n has to list, so that it meets all partners by light sets."""
        return sorted({self.overlap(n, m) for m in self.partners(n) if min(n, m) <= boundary and m > 0})


class _Sets:
    """The shingle sets of a block's texts: hashes in order, text by text."""

    def __init__(self, rows: pa.Table, shingle: int):
        texts = [t.translate(_LOWER) for t in B.encoded(rows)]
        words = B.split_words(texts)
        n_words = words.last - words.first
        at = words.windows(shingle)
        few = np.flatnonzero((n_words > 0) & (n_words < shingle))
        starts = np.concatenate([at, words.first[few]])
        ends = np.concatenate([at + shingle, words.last[few]])
        of = np.concatenate([np.searchsorted(words.last, at, side="right"), few])
        h = B.run_hashes(words.hashes, starts, ends)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.shingles, self.of = h[new], of[new]
        self.sizes = np.bincount(self.of, minlength=len(texts))
        self.last = np.cumsum(self.sizes)
        self.first = self.last - self.sizes
        digests = [B.run_hashes(self.shingles, self.first, self.last, k) for k in (0, 1)]
        self.nodes = [a.tobytes() for a in np.stack(digests, 1).astype(">u8")]


def _leads(docs: DataFrame, key: str, text: str, shape: B.Layout) -> DataFrame:
    """The least key of each different text, in the form of an answer to its block; a hot text is aggregated first."""
    rows = B.dealt(docs, key, text, shape).select("block", "key", F.md5(F.col("text").cast("binary")).alias("digest"))
    least = rows.groupBy("digest").agg(F.min(F.struct("key", "block")).alias("l"))
    return least.select(F.lit(_LEADS).alias("part"), "l.block", F.col("l.key").cast("string").cast("binary").alias("payload"))


def _is_lead(rows: pa.Table, got: pa.Table) -> np.ndarray:
    """Which rows of a block stand for their text. (Texts with one key may all do so; that costs no more than time.)"""
    mine = got.filter(pa.array(got["part"].to_numpy() == _LEADS))["payload"].to_pylist()
    return np.isin(rows["key"].to_numpy(), np.array([int(x) for x in mine], np.int64))


def _parity(shingles: np.ndarray, width: int) -> np.ndarray:
    """Whether each of ``width`` buckets holds an odd number of the shingles, as 64-bit words."""
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _set_rows(x: _Sets, rows: pa.Table, leads: np.ndarray, codes: np.ndarray, place: np.ndarray, t: Threshold) -> pa.Table:
    """One row per document; the set itself with the first document of each different set among those of ``leads``."""
    code = np.zeros(len(x.shingles), np.uint8)
    code[leads[x.of]] = codes[place] if len(place) else 0
    seen: set[bytes] = set()
    lead, prefix_t, prefix_p, prefix_n, fold, parity, members = [], [], [], [0], [], [], []
    for node, n, a, b, stands in zip(x.nodes, x.sizes.tolist(), x.first.tolist(), x.last.tolist(), leads.tolist()):
        first = stands and n > 0 and node not in seen
        if first:
            seen.add(node)
        lead.append(first)
        count, held, words, folded = 0, None, [], [0] * FOLD
        if first:
            shingles = x.shingles[a:b]
            order = np.lexsort((shingles, code[a:b]))[: t.probe(n)]
            common = code[a:b][order] > 1
            p = np.flatnonzero(common)
            count = len(p)
            prefix_t.append(shingles[order[p]])
            prefix_p.append(p)
            if count:
                words, folded = _parity(shingles, 1 << max(6, (2 * n - 1).bit_length())), _parity(shingles, 64 * FOLD)
            if count or n <= 2 * MOST_LIGHT:
                held = shingles.tobytes()
        prefix_n.append(prefix_n[-1] + count)
        fold.append(folded)
        parity.append(words)
        members.append(held)
    folds = np.array(fold, np.int64).reshape(-1, FOLD)
    structs = pa.StructArray.from_arrays(
        [
            pa.array(np.concatenate([*prefix_t, np.empty(0, np.uint64)]).astype(np.int64)),
            pa.array(np.concatenate([*prefix_p, np.empty(0, np.int64)]).astype(np.int32)),
        ],
        ["t", "p"],
    )
    return pa.table(
        {
            "key": rows["key"],
            "no_key": rows["no_key"],
            "digest": pa.array([hashlib.md5(t).digest() for t in B.encoded(rows)], pa.binary()),
            "n": pa.array(x.sizes, pa.int32()),
            "node": pa.array(x.nodes, pa.binary()),
            "lead": pa.array(lead, pa.bool_()),
            "prefix": pa.ListArray.from_arrays(pa.array(prefix_n, pa.int32()), structs),
            **{f: pa.array(folds[:, i]) for i, f in enumerate(_FOLD)},
            "parity": pa.array(parity, pa.list_(pa.int64())),
            "members": pa.array(members, pa.binary()),
        }
    )


def sets(docs: DataFrame, key: str, text: str, shingle: int, t: Threshold) -> DataFrame:
    """A row per document with its set's size and digest, and the set where it may have partners; written once."""
    shape = B.layout(docs, text, 6.0)
    rows = B.dealt(docs, key, text, shape)
    bits = np.uint64(64 - shape.bits)

    leads = _leads(docs, key, text, shape)

    def ask(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        x = _Sets(table, shingle)
        values, times, _ = B.distinct(x.shingles[_is_lead(table, got)[x.of]] >> bits)
        return B.requests(block, values, times, shape)

    def hold(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        x, stands = _Sets(table, shingle), _is_lead(table, got)
        _, _, place = B.distinct(x.shingles[stands[x.of]] >> bits)
        codes = B.answer_for(got.filter(pa.array(got["part"].to_numpy() != _LEADS)))
        return _set_rows(x, table, stands, codes, place, t)

    answers = B.answered(B.with_answers(rows, leads, ask, B.REQUEST))
    return materialize(B.with_answers(rows, answers.unionByName(leads), hold, _SETS), "sets")


def choose_boundary(held: DataFrame, t: Threshold) -> int:
    """The boundary of least cost: subsets to list below it, list entries to scan above it."""
    lists = held.select("n", F.explode("prefix.t").alias("t"))
    long = lists.groupBy("t").agg(F.count("*").alias("length"))
    scans = lists.where(F.col("n") <= MOST_LIGHT).join(long, "t").groupBy("n").agg(F.sum("length").alias("cost"))
    scan = {r["n"]: r["cost"] for r in scans.collect()}  # MOST_LIGHT rows at most
    count = {r["n"]: r["c"] for r in held.where("lead").where(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}

    def cost(boundary: int) -> int:
        listed = sum(c * sum(comb(n, k) for k in t.shared(n, boundary)) for n, c in count.items())
        return listed + sum(c for n, c in scan.items() if n > boundary)

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _subsets(nodes: DataFrame, boundary: int, t: Threshold) -> DataFrame:
    """(subset, n, node) of light sets and of those just above that may be partners of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, data in zip(batch.column("node"), batch.column("n").to_pylist(), batch.column("members")):
                shingles = np.frombuffer(data.as_py(), np.uint64)
                for k in t.shared(n, boundary):
                    # A subset is known by what it leaves out: its hash is a sum over its members.
                    spread = B.mix(shingles + np.uint64(k) * B._STEP[0]), B.mix(shingles + np.uint64(k) * B._STEP[1])
                    out = list(combinations(range(n), n - k))
                    gone = np.array(out, np.int64).reshape(len(out), n - k)
                    sums = [s.sum(dtype=np.uint64) - s[gone].sum(1, dtype=np.uint64) for s in spread]
                    names = [a.tobytes() for a in np.stack(sums, 1)]
                    m = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.binary()), pa.array([k] * m, pa.int32()), pa.array([n] * m, pa.int32()), pa.array([node.as_py()] * m, pa.binary())],
                        ["subset", "k", "n", "node"],
                    )

    small = nodes.where((F.col("n") <= boundary * 100 // t.percent) & F.col("members").isNotNull())
    return small.select("node", "n", "members").mapInArrow(run, "subset binary, k int, n int, node binary")


def light_links(nodes: DataFrame, boundary: int, t: Threshold) -> DataFrame:
    """Links by common subsets: every set with the smallest of those that have the subset, if sizes allow."""
    listed = _subsets(nodes, boundary, t)
    least = listed.groupBy("subset", "k").agg(F.min(F.struct("n", "node")).alias("least"))
    need = F.ceil(F.lit(t.percent) * (F.col("n") + F.col("least.n")) / F.lit(100 + t.percent))
    pairs = listed.join(least, ["subset", "k"]).where((F.col("node") != F.col("least.node")) & (need <= F.col("k")))
    return pairs.select(F.col("node").alias("a"), F.col("least.node").alias("b"))


def _differences(a: Column, b: Column) -> Column:
    """A lower bound of the number of shingles in one of two sets only: parities that differ, at one width."""

    def halved(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    def narrow(x: Column, y: Column) -> Column:
        return F.when(F.size(x) > F.size(y), halved(x)).otherwise(x)

    return F.aggregate(F.zip_with(narrow(a, b), narrow(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)


def _allowed(n: Column, m: Column, t: Threshold) -> Column:
    """How many shingles of two linked sets may be in one of them only."""
    return n + m - 2 * F.ceil(F.lit(t.percent) * (n + m) / F.lit(100 + t.percent))


def _may_link(a: str, b: str, t: Threshold) -> Column:
    """Whether sizes, places of the common shingle and folded parities allow two sets to be linked. a is the larger."""
    n, m, p, q = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.p"), F.col(f"{b}.p")
    need = F.ceil(F.lit(t.percent) * (n + m) / F.lit(100 + t.percent))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in _FOLD])
    return (100 * m >= t.percent * n) & (F.least(n - p, m - q) >= need) & (differ <= _allowed(n, m, t))


def _verified(pairs: DataFrame, held: DataFrame, t: Threshold) -> DataFrame:
    """The pairs of nodes that are linked, by their parities in full and then by comparison of the sets."""
    held = held.where("lead").withColumn("size", F.struct("n", "parity"))

    def both(pairs: DataFrame, column: str) -> DataFrame:
        """The pairs with what their nodes hold, x and y. A node may be held by several blocks; any one of its equal sets will do."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        each = held.select("node", column).join(named, "node").groupBy("node").agg(F.first(column).alias("of"))
        for side, name in (("a", "x"), ("b", "y")):
            pairs = pairs.join(each.select(F.col("node").alias(side), F.col("of").alias(name)), side)
        return pairs

    wide = both(materialize(pairs, "pairs"), "size")
    few = _differences(F.col("x.parity"), F.col("y.parity")) <= _allowed(F.col("x.n"), F.col("y.n"), t)
    with_both = both(materialize(wide.where(few).select("a", "b"), "near"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= t.percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def heavy_links(held: DataFrame, boundary: int, t: Threshold) -> DataFrame:
    """Links of sets that are both above the boundary."""
    heavy = held.where("lead").where(F.col("n") > boundary)
    entries = heavy.select("node", "n", *_FOLD, F.inline("prefix")).select("t", "p", "n", "node", *_FOLD).distinct()
    # A list of one set is no list.
    several = entries.groupBy("t").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u != v").select("t")
    lists = materialize(entries.join(several, "t", "left_semi"), "lists")
    entry = F.struct("p", "n", "node", *_FOLD)
    center = lists.groupBy("t").agg(F.min(entry).alias("c"))
    met = lists.select("t", entry.alias("e")).join(center, "t").where(F.col("e.node") != F.col("c.node"))
    larger = F.col("e.n") > F.col("c.n")
    met = met.select(F.when(larger, F.col("e")).otherwise(F.col("c")).alias("x"), F.when(larger, F.col("c")).otherwise(F.col("e")).alias("y"))
    pair = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
    first = materialize(_verified(met.where(_may_link("x", "y", t)).select(*pair).distinct(), held, t), "links")
    # What hangs together so far, as far as a few rounds show; the rest of each list meets across these groups only.
    first = tightened(first, rounds=EARLY_ROUNDS)
    root = first.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    grouped = lists.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = materialize(grouped, "grouped")
    apart = grouped.groupBy("t").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u != v").select("t")
    open_lists = grouped.join(apart, "t", "left_semi")
    fields = F.struct("p", "n", "node", *_FOLD, "root")
    larger_side = open_lists.select("t", fields.alias("x"))
    # The smaller of two sets has the shingle among the few that any larger partner must share.
    smaller_side = open_lists.where(F.col("p") < F.col("n") - F.ceil(F.lit(2 * t.percent) * F.col("n") / F.lit(100 + t.percent)) + 1).select("t", fields.alias("y"))
    order = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") > F.col("y.node")))
    rest = larger_side.join(smaller_side, "t").where(order & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", t))
    return first.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(_verified(rest.select(*pair).distinct(), held, t))


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """key, no_key, the text's digest, n and group of each row; no group without a set."""
    if percent < 50:
        raise ValueError("parities of sets are compared at widths that fit similarities of 50 per cent or more")
    t = Threshold(percent)
    held = sets(docs, key, text, shingle, t)
    boundary = choose_boundary(held.where("lead"), t)
    nodes = held.where("lead").select("node", "n", "members").dropDuplicates(["node"])
    links = heavy_links(held, boundary, t).union(light_links(nodes, boundary, t))
    root = roots(links)
    rows = held.select("key", "no_key", "digest", "n", "node").join(root, "node", "left")
    return rows.withColumn("group", F.when(F.col("n") > 0, F.coalesce("root", "node")))  # none without a set: alone


def components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: key, n_shingles and component_id, the least key that is reachable by links."""
    rows = _grouped(docs, key, text, shingle, percent)
    # Written, so that what is joined is not what was aggregated: the join of a large group can then be split.
    least = materialize(rows.where("n > 0").groupBy("group").agg(F.min("key").alias("least")), "least")
    out = rows.join(least, "group", "left")
    shown = F.coalesce("least", "key")
    return out.select(
        F.when(~F.col("no_key"), F.col("key")).alias(key),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(shown != B.NULL_KEY, shown).alias("component_id"),
    )


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of least key and then of least text digest, with its own columns.

    Rows are told apart by key and text, so a key that occurs with several texts loses only those that are near another
    document. Rows without a set are no duplicates of each other; of rows equal in key and text, one stays."""
    grouped = _grouped(docs, key, text, shingle, percent).where("n > 0").select("group", F.struct("key", (~F.col("no_key")).alias("has_key"), "digest").alias("id"))
    # Written, so that what is joined is not what was aggregated: the join of a large group can then be split.
    least = materialize(grouped.groupBy("group").agg(F.min("id").alias("least")), "least")
    gone = grouped.join(least, "group").where(F.col("id") != F.col("least")).select("id.*").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(key).cast("long"), F.lit(B.NULL_KEY)).alias("key"),
        F.col(key).isNotNull().alias("has_key"),
        F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"),
    )
    kept = rows.join(gone, ["key", "has_key", "digest"], "left_anti")
    again = F.row_number().over(Window.partitionBy("key", "has_key", "digest").orderBy("key"))
    return kept.withColumn("again", again).where("again = 1").select("row.*")
