"""Removal of word windows that occur earlier, with a count-min prefilter.

Every block of documents sketches its windows: counters at the leading bits of the window hash, in sparse form. The
sketches of all blocks are merged by counter, range by range, so a counter says at least as much as the window
count: nothing repeated is lost, and about one unique window in 2^5 is taken for repeated. In the second pass only
windows with a counter of two or more are grouped exactly, by 128 bits of hash, and each block learns which of its
windows is the first of the corpus. All others start earlier elsewhere, and the words they cover go.

The order of documents is that of their keys; a null key comes first, and rows with equal keys follow their texts.

* Null and empty texts have no words. Texts below a window of words are left as they are.
* Repeated rows: the first keeps its words, the others lose all that windows cover.
* Only key and text are looked at, so other columns can't clash. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.llm import blocks as B

WINDOW = 20
_FIRST = "part int, block long, payload binary"
# One entry of the second pass: two hashes, the document and the word at which the window starts.
_ENTRY = np.dtype([("a", np.uint64), ("b", np.uint64), ("key", np.int64), ("at", np.int64)])


class _Block:
    """Windows of one block: their places, hashes and counters."""

    def __init__(self, rows: pa.Table, shape: B.Layout, length: int):
        self.texts = list(B.encoded(rows))
        self.keys = rows["key"].to_numpy()
        self.words = B.split_words(self.texts)
        self.at = self.words.windows(length)
        self.length = length
        self.a = B.run_hashes(self.words.hashes, self.at, self.at + length)
        self.counters, self.times, self.place = B.distinct(self.a >> np.uint64(64 - shape.bits))

    def suspects(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose counter is two or more; their distinct entries by hash; the entry of each window.

        An entry stands for its first window in the block."""
        seen = np.flatnonzero(codes[self.place] >= 2) if len(self.place) else np.empty(0, np.int64)
        at = self.at[seen]
        b = B.run_hashes(self.words.hashes, at, at + self.length, 1)
        order = np.lexsort((at, b, self.a[seen]))
        a_sorted, b_sorted = self.a[seen][order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (a_sorted[1:] != a_sorted[:-1]) | (b_sorted[1:] != b_sorted[:-1])
        first = order[new]
        entries = np.empty(len(first), _ENTRY)
        entries["a"], entries["b"] = self.a[seen][first], b[first]
        doc = np.searchsorted(self.words.last, at[first], side="right")
        entries["key"], entries["at"] = self.keys[doc], at[first] - self.words.first[doc]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        return at, entries, np.where(at == at[first[entry]], entry, -1) if len(order) else entry


def _pack(entries: np.ndarray) -> bytes:
    fields = [B.squeeze(np.ascontiguousarray(entries[f])) for f in _ENTRY.names]
    return b"".join(len(x).to_bytes(8) + x for x in fields)


def _unpack(data: bytes) -> np.ndarray:
    parts, at = [], 0
    for f in _ENTRY.names:
        n = int.from_bytes(data[at : at + 8])
        parts.append(B.expand(data[at + 8 : at + 8 + n], _ENTRY[f].type))
        at += 8 + n
    out = np.empty(len(parts[0]), _ENTRY)
    for f, x in zip(_ENTRY.names, parts):
        out[f] = x
    return out


def _which_are_first(rows: pa.Table) -> pa.Table:
    """For each entry of each block whether it is the first of its window in the corpus."""
    blocks = rows["block"].to_pylist()
    got = [_unpack(x) for x in rows["payload"].to_pylist()]
    sizes = np.cumsum([0, *map(len, got)])
    block = np.repeat(np.array(blocks), np.diff(sizes))
    e = np.concatenate(got)
    order = np.lexsort((block, e["at"], e["key"], e["b"], e["a"]))
    new = np.ones(len(order), bool)
    new[1:] = (e["a"][order][1:] != e["a"][order][:-1]) | (e["b"][order][1:] != e["b"][order][:-1])
    out = np.zeros(len(order), np.uint8)
    out[order[new]] = 1
    payloads = [B.squeeze(out[x:y]) for x, y in zip(sizes, sizes[1:])]
    return pa.table({"part": rows["part"], "block": rows["block"], "payload": pa.array(payloads, pa.binary())})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """Per document: key, n_words, n_removed and kept, the kept words joined by one blank."""
    return _removed(docs, key, text, length, lambda kept: kept.decode(), "string").withColumnRenamed("out", "kept")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """The same with kept_sha256, the digest of the kept words, in place of the words."""
    found = _removed(docs, key, text, length, lambda kept: hashlib.sha256(kept).hexdigest(), "string")
    return found.withColumnRenamed("out", "kept_sha256")


def _removed(docs: DataFrame, key: str, text: str, length: int, finish, kind: str) -> DataFrame:
    shape = B.layout(docs, text, 6.0)
    rows = B.dealt(docs, key, text, shape)

    def sketch(block: int, table: pa.Table) -> pa.Table:
        x = _Block(table, shape, length)
        return B.requests(block, x.counters, x.times, shape)

    def suspects(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        x = _Block(table, shape, length)
        _, entries, _ = x.suspects(B.answer_for(got))
        parts = (entries["a"] >> np.uint64(64 - shape.range_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts)) + 1
        lows, highs = [0, *cuts.tolist()], [*cuts.tolist(), len(entries)]
        return B.request_table(block, [(int(parts[a]), _pack(entries[a:b])) for a, b in zip(lows, highs) if b > a])

    def remove(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        x = _Block(table, shape, length)
        second = got["second"].to_numpy(zero_copy_only=False).astype(bool)
        at, _, entry = x.suspects(B.answer_for(got.filter(pa.array(~second))))
        first = B.answer_for(got.filter(pa.array(second)))
        # A window stays where it is its block's first and that is the corpus's first.
        keeps = np.zeros(len(at), bool)
        own = entry >= 0
        keeps[own] = first[entry[own]] == 1
        gone = at[~keeps]
        edge = np.zeros(len(x.words.hashes) + length + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + length, -1)
        covered = np.cumsum(edge)[: len(x.words.hashes)] > 0
        sums = np.append(0, np.cumsum(covered))
        n_removed = sums[x.words.last] - sums[x.words.first] if len(x.texts) else np.empty(0, np.int64)
        out = []
        for t, a, b, n in zip(x.texts, x.words.first.tolist(), x.words.last.tolist(), n_removed.tolist()):
            words = t.split()
            out.append(finish(b" ".join(compress(words, ~covered[a:b]) if n else words)))
        return pa.table(
            {
                "key": table["key"],
                "no_key": table["no_key"],
                "n_words": pa.array(x.words.last - x.words.first, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "out": pa.array(out, pa.string()),
            }
        )

    answers = B.answered(B.each_block(rows, sketch, B.REQUEST))
    asked = B.with_answers(rows, answers, suspects, B.REQUEST)
    firsts = asked.groupBy("part").applyInArrow(_which_are_first, _FIRST)
    both = answers.withColumn("second", F.lit(False)).unionByName(firsts.withColumn("second", F.lit(True)))
    schema = f"key long, no_key boolean, n_words long, n_removed long, out {kind}"
    out = B.with_answers(rows, both, remove, schema)
    return out.select(F.when(~F.col("no_key"), F.col("key")).alias(key), "n_words", "n_removed", "out")
