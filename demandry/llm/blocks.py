"""Documents in blocks, and questions about hashes that all blocks ask together.

Several operators need to know how often a hash occurs in the whole corpus while holding far too many hashes to
shuffle one row each. Documents are dealt to blocks once; a block sends its distinct hashes, sorted and packed as
differences (about two bytes each), one row to each hash range; a range adds up what all blocks sent and answers each
of them with one small code per hash, in the order in which they were sent. Nothing goes through the driver, nothing is
broadcast, and a hash that is everywhere costs one entry per block.

The dealt documents are read again for the answers. Both reads have the same plan, so Spark shuffles the texts
once and uses the exchange again; after the loss of an executor it deals them out again in the same way, as the block
depends on key and text alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MB = 1 << 20
# Bytes of text per block: near the square root of the total, so that blocks and ranges grow together.
LEAST_BLOCK, MOST_BLOCK = MB, 64 * MB
ENTRIES_PER_RANGE = MB
SPARE_BITS = 5  # a hash meets one of a full table of others with a chance of 1 / 2^SPARE_BITS
NULL_KEY = -(2**63)

REQUEST = "part int, block long, payload binary"


@dataclass(frozen=True)
class Layout:
    """Numbers of blocks and hash ranges, and bits of a hash that are counted, for a corpus of some size."""

    blocks: int
    range_bits: int
    bits: int


def layout(docs: DataFrame, text: str, bytes_per_hash: float) -> Layout:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"] + 1
    size = min(MOST_BLOCK, max(LEAST_BLOCK, math.isqrt(total) * 64))
    hashes = max(1, int(total / bytes_per_hash))
    range_bits = max(2, math.ceil(math.log2(hashes / ENTRIES_PER_RANGE + 1)) + 1)
    return Layout(-(-total // size), range_bits, min(62, max(math.ceil(math.log2(hashes)) + SPARE_BITS, range_bits + 8)))


def dealt(docs: DataFrame, key: str, text: str, shape: Layout) -> DataFrame:
    """block, key and text (null: empty) of all rows; null keys as NULL_KEY."""
    return docs.select(
        F.pmod(F.xxhash64(key, text), F.lit(shape.blocks)).alias("block"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.col(key).isNull().alias("no_key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def in_order(rows: pa.Table) -> pa.Table:
    """A block's rows by key, and by text where keys are equal: the same order at every read."""
    return rows.sort_by([("key", "ascending"), ("no_key", "descending"), ("text", "ascending")])


def squeeze(a: np.ndarray) -> bytes:
    """An array of whole numbers as bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def pack(values: np.ndarray, weights: np.ndarray) -> bytes:
    """Sorted distinct hashes with small weights (0 to 255)."""
    steps = np.diff(values, prepend=np.uint64(0))
    if steps.max(initial=0) < 2**32:
        steps = steps.astype(np.uint32)
    return bytes([steps.itemsize]) + len(values).to_bytes(8) + _sized(squeeze(steps)) + squeeze(weights.astype(np.uint8))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n = data[0], int.from_bytes(data[9:17])
    steps = expand(data[17 : 17 + n], np.uint32 if size == 4 else np.uint64)
    return np.cumsum(steps, dtype=np.uint64), expand(data[17 + n :], np.uint8)


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(8) + data


def requests(block: int, values: np.ndarray, weights: np.ndarray, shape: Layout) -> pa.Table:
    """One row per hash range with the block's sorted distinct hashes of ``shape.bits`` bits."""
    parts = (values >> np.uint64(shape.bits - shape.range_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(parts)) + 1
    lows, highs = [0, *cuts.tolist()], [*cuts.tolist(), len(values)]
    kept = [(int(parts[a]), pack(values[a:b], weights[a:b])) for a, b in zip(lows, highs) if b > a]
    return request_table(block, kept)


def request_table(block: int, kept: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "part": pa.array([p for p, _ in kept], pa.int32()),
            "block": pa.array([block] * len(kept), pa.int64()),
            "payload": pa.array([x for _, x in kept], pa.binary()),
        }
    )


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, how often each occurs (255 at most), and the place of each value among them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    times = np.minimum(np.diff(np.append(first, len(values))), 255).astype(np.uint8)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], times, place


def code(counts: np.ndarray) -> np.ndarray:
    """A count as one byte: itself below 64, then by eighths of powers of two. Never falls as the count grows."""
    large = 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64))
    return np.where(counts < 64, counts, np.minimum(large, 255)).astype(np.uint8)


def answered(asked: DataFrame) -> DataFrame:
    """part, block and payload: for each request the codes of the corpus-wide counts of its hashes, in order."""

    def add_up(rows: pa.Table) -> pa.Table:
        parts, blocks = rows["part"].to_pylist(), rows["block"].to_pylist()
        got = [unpack(x) for x in rows["payload"].to_pylist()]
        sizes = np.cumsum([0, *[len(v) for v, _ in got]])
        values = np.concatenate([v for v, _ in got])
        weights = np.concatenate([w for _, w in got])
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        sums = np.add.reduceat(weights[order].astype(np.int64), first)
        out = np.empty(len(values), np.uint8)
        out[order] = np.repeat(code(sums), np.diff(np.append(first, len(values))))
        return pa.table(
            {
                "part": pa.array(parts, pa.int32()),
                "block": pa.array(blocks, pa.int64()),
                "payload": pa.array([squeeze(out[a:b]) for a, b in zip(sizes, sizes[1:])], pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(add_up, REQUEST)


def answer_for(block_answers: pa.Table, dtype: type = np.uint8) -> np.ndarray:
    """The answers to one block, in the order of its sorted hashes."""
    rows = sorted(zip(block_answers["part"].to_pylist(), block_answers["payload"].to_pylist()))
    return np.concatenate([expand(x, dtype) for _, x in rows]) if rows else np.empty(0, dtype)


def each_block(rows: DataFrame, work: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return work(key[0].as_py(), in_order(table))

    return rows.groupBy("block").applyInArrow(run, schema)


def with_answers(rows: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each block's rows and what it was answered."""

    def run(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return work(key[0].as_py(), in_order(table), got)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


# --- hashes of words and of runs of words, on arrays ---

_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        base = int(_STEP[which])
        both = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(max(n, 1 << 16), np.uint64(b))
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        held = _POWERS[which] = (both[0], both[1])
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run ``values[start:end]`` of numbers, by prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP[1 - which])


@dataclass(frozen=True)
class Words:
    """Words of many texts: their hashes in order, and where the words of each text begin and end among them."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def windows(self, length: int) -> np.ndarray:
        """Places of all words at which ``length`` words of one text begin."""
        n = len(self.hashes)
        ok = np.zeros(n, bool)
        for a, b in zip(self.first.tolist(), self.last.tolist()):
            ok[a : max(a, b - length + 1)] = True
        return np.flatnonzero(ok)


def split_words(texts: list[bytes]) -> Words:
    """Words are runs of anything but the six white-space signs of ASCII."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    word = ~_BLANK[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    after = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    last = np.searchsorted(starts, after)
    first = np.append(0, last[:-1]) if len(last) else last
    return Words(run_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends), first, last)


def encoded(rows: pa.Table) -> Iterator[bytes]:
    return (t.encode() for t in rows["text"].to_pylist())
