"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one window). Of the hashes
of all ``GRAM``-word grams, every ``WINDOW - GRAM + 1`` neighbours give their least to the fingerprints; as so many
neighbours are just one window, each window, in an item as in a document, has a fingerprint that depends on its
words alone. So documents and items that share a window share a fingerprint: fingerprints are joined, and each meeting
is extended word by word to the windows around it. Nothing is missed, and hash collisions fall away.

Documents are scanned row by row. Fingerprints of a benchmark within ``BROADCAST_FINGERPRINTS`` are broadcast (the
bound is checked by a count), so nothing of the documents is shuffled but hits; beyond it, a shuffle of fingerprints
alone finds the documents that have one in common with an item, and only theirs are joined with their words.

* Null text has no words and no hits; so has empty text. Items without words, or with a null text, have no windows.
* Null item ids are left out of the list of items, but their windows count. Repeated items count once.
* Repeated documents: one result each; rows with one key but different texts are judged apart.
* Only key and text are looked at, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.llm.common import let, lower_ascii

WINDOW, GRAM = 10, 6
NEIGHBOURS = WINDOW - GRAM + 1
BROADCAST_FINGERPRINTS = 200_000
_MOST_SIEVE_BITS = 23


def item_words(text: Column) -> Column:
    """Words in lower case (A-Z only): runs of letters, digits and everything outside ASCII."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    return F.filter(parts, lambda w: w != "")


def _count_words(text: Column) -> Column:
    """How many words item_words finds, without changing the case."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    blank = lambda e: F.when(e == "", F.lit(1)).otherwise(F.lit(0))
    # Only the first and the last part can be empty; a text without words has one empty part or two.
    return let(parts, lambda p: F.size(p) - blank(p[0]) - F.when(F.size(p) > 1, blank(F.element_at(p, -1))).otherwise(F.lit(0)))


def gram_hashes(words: Column, length: int) -> Column:
    """Hash of the ``length`` words from each position on, made of the hashes of the words."""

    def grams(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, length)]))
        return F.slice(each, F.lit(1), F.greatest(F.size(h) - (length - 1), F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def _least(hashes: Column) -> Column:
    """The least of every NEIGHBOURS hashes in a row; none if there are fewer."""
    each = F.transform(hashes, lambda x, i: F.least(x, *[F.get(hashes, i + k) for k in range(1, NEIGHBOURS)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - (NEIGHBOURS - 1), F.lit(0)))


def _winnowed(words: Column, sieve: Column | None = None) -> Column:
    """(fp, at, left, around) of all grams whose hash is the least of some NEIGHBOURS hashes in a row.

    around: the gram and up to NEIGHBOURS - 1 words on either side, ``left`` of them before it. A ``sieve`` leaves
    out hashes that it does not hold (see _sieve)."""

    def with_words(fp: Column, at: Column) -> Column:
        left = F.least(at, F.lit(NEIGHBOURS - 1))
        around = F.slice(words, at + 1 - left, left + (GRAM + NEIGHBOURS - 1))
        return F.struct(fp.alias("fp"), at.alias("at"), left.alias("left"), around.alias("around"))

    def places(h: Column) -> Column:
        kept = _least(h) if sieve is None else F.filter(_least(h), lambda x: _held(sieve, x))
        found = lambda k: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(k, x), with_words(x, i))), lambda s: s.isNotNull())
        return let(F.array_distinct(kept), lambda k: F.when(F.size(k) > 0, found(k)))

    def all_places(h: Column) -> Column:
        is_least = lambda m, x, i: x == F.greatest(*[F.get(m, i - k) for k in range(NEIGHBOURS)])
        return let(_least(h), lambda m: F.filter(F.transform(h, lambda x, i: F.when(is_least(m, x, i), with_words(x, i))), lambda s: s.isNotNull()))

    return let(gram_hashes(words, GRAM), all_places if sieve is None else places)


def _held(sieve: Column, x: Column) -> Column:
    bits = F.size(sieve) * 64
    place = F.pmod(x, bits.cast("long")).cast("int")
    return F.getbit(F.get(sieve, F.shiftright(place, 6)), F.pmod(place, F.lit(64)).cast("int")) == 1


def _sieve(prints: DataFrame) -> Column:
    """A bit for each remainder that a fingerprint leaves: an array of 64-bit words, a constant of the plan.

    Only for fingerprints within BROADCAST_FINGERPRINTS; they and the sieve (1 MB at most) pass through the driver."""
    found = [r["fp"] for r in prints.select("fp").distinct().collect()]
    bits = 1 << min(_MOST_SIEVE_BITS, max(12, (1024 * len(found)).bit_length()))
    words = [0] * (bits // 64)
    for x in found:
        words[x % bits // 64] |= 1 << x % 64
    signed = [w - (w >> 63 << 64) for w in words]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _agree(a: Column, b: Column, at_a: Column, at_b: Column, step: int) -> Column:
    """How many words agree in a row from two places on, one way, up to NEIGHBOURS - 1."""
    agree = lambda k: F.coalesce(F.get(a, at_a + k * step) == F.get(b, at_b + k * step), F.lit(False))
    out = F.lit(NEIGHBOURS - 1)
    for k in range(NEIGHBOURS - 2, -1, -1):
        out = F.when(~agree(k), F.lit(k)).otherwise(out)
    return out


def _range() -> Column:
    """The words (start, end) around a gram met in document and item that windows of the item cover; null if none.

    A window with that gram begins at most NEIGHBOURS - 1 words before it."""
    w, i, p, q = F.col("around"), F.col("item_around"), F.col("left"), F.col("item_left")
    same = F.slice(w, p + 1, GRAM) == F.slice(i, q + 1, GRAM)
    left, right = _agree(w, i, p - 1, q - 1, -1), _agree(w, i, p + GRAM, q + GRAM, 1)
    return F.when(same & (left + right + GRAM >= WINDOW), F.struct((F.col("at") - left).alias("start"), (F.col("at") + GRAM + right).alias("end")))


def _covered(ranges: Column) -> Column:
    """Words in the union of ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, r: Column) -> Column:
        new = F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["end"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], r["end"]).alias("end"))

    return F.aggregate(F.array_sort(ranges), start, add, lambda acc: acc["n"])


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS


def _long_ranges(docs: DataFrame, items: DataFrame) -> DataFrame:
    """__key, __id, item and range, by fingerprints. docs: __key, __id, w; items: item, iw.

    A fingerprint goes with the words around it, never with its document."""
    prints = items.where(F.size("iw") >= WINDOW).select("item", F.inline(_winnowed(F.col("iw"))))
    prints = prints.select("fp", "item", F.col("left").alias("item_left"), F.col("around").alias("item_around")).distinct()
    long = docs.where(F.size("w") >= WINDOW)
    of = lambda rows, sieve=None: rows.select("__key", "__id", F.inline(let(F.col("w"), lambda w: _winnowed(w, sieve))))
    if _few(prints):
        met = of(long, _sieve(prints)).join(F.broadcast(prints), "fp")
    else:
        some = of(long).select("__key", "__id", "fp").join(prints.select("fp").distinct(), "fp", "left_semi").select("__key", "__id").distinct()
        some = some.withColumnsRenamed({"__key": "__k", "__id": "__i"})
        met = of(long.join(some, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__id") == F.col("__i")), "left_semi")).join(prints, "fp")
    return met.select("__key", "__id", "item", _range().alias("range")).where(F.col("range").isNotNull())


def _short_ranges(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """The same for items of ``length`` words, below a window."""
    small = items.where(F.size("iw") == length).select(F.element_at(gram_hashes(F.col("iw"), length), 1).alias("fp"), "item", "iw")

    def grams(w: Column) -> Column:
        return F.transform(gram_hashes(w, length), lambda h, i: F.struct(h.alias("fp"), i.alias("at"), F.slice(w, i + 1, length).alias("around")))

    met = docs.select("__key", "__id", F.inline(let(F.col("w"), grams)))
    met = met.join(F.broadcast(small) if _few(small) else small, "fp").where(F.col("around") == F.col("iw"))
    return met.select("__key", "__id", "item", F.struct(F.col("at").alias("start"), (F.col("at") + length).alias("end")).alias("range"))


def hits(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """__key, __id, n_hit and items (ids as text, sorted) of the documents with a hit.

    __id tells texts of one key apart."""
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__id"), item_words(F.col(text)).alias("w"))
    # Equal item texts have the same windows: one row with the list of their ids. (Two items may share some
    # windows only; those meet as two rows.)
    bench = items.select(F.col(item).cast("string").alias("item"), item_words(F.col(item_text)).alias("iw"))
    bench = bench.where(F.size("iw") > 0).groupBy("iw").agg(F.collect_set("item").alias("item"))
    lengths = [r[0] for r in bench.where(F.size("iw") < WINDOW).select(F.size("iw")).distinct().collect()]  # at most WINDOW - 1
    found = _long_ranges(rows, bench)
    for n in sorted(lengths):
        found = found.unionByName(_short_ranges(rows, bench, n))
    return found.groupBy("__key", "__id").agg(
        _covered(F.collect_set("range")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item")))).alias("items"),
    )


def report(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items and contaminated."""
    found = hits(docs, items, key=key, text=text, item=item, item_text=item_text)
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__id"), _count_words(F.col(text)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(
        found.withColumnsRenamed({"__key": "__key2", "__id": "__id2"}), F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__id") == F.col("__id2")), "left"
    ).select(
        F.col("__key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns."""
    found = hits(docs, items, key=key, text=text, item=item, item_text=item_text)
    same = docs[key].eqNullSafe(found["__key"]) & (F.xxhash64(docs[text]) == found["__id"])
    return docs.join(found, same, "left_anti")
