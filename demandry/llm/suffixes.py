"""Removal of byte strings that occur twice, by column-wise construction of suffix arrays for many strings.

**Which strings.** Of all grams of a ``length``-byte window, the one of least hash (the leftmost of equals) anchors
the window. Neighbouring windows with one anchor make a segment; those that reach further right of the anchor and
those that reach further left are kept apart, so each segment has a core of over half a window that all its windows
share. Equal windows have equal anchors and cores. Cores that occur once in the corpus are dropped by counting
(see blocks), which loses nothing; equal segments of a block are sent once, with their number.

**Which windows.** The segments of a range of cores form a collection of strings over symbols of eight bytes, on a
grid fixed by the anchor. Round by round one symbol of each string, from its end to its start, is put before the
suffix that was inserted last: the collection's Burrows-Wheeler transform says where, and the common prefix with
both neighbours is one more than the least common prefix between them. The columns of symbols, the transform, the
common prefixes and the owners of the suffixes are external files that each round reads and writes in order.
Suffixes with 49 common symbols then form classes, within which the few bytes before and after decide about
windows that begin between grid lines.

Matches do not cross documents. Every byte inside a string that also starts elsewhere goes.

* Null and empty texts have no bytes. Texts below the length are left as they are.
* Repeated rows lose all bytes that windows cover, all of them, as each starts elsewhere too.
* Only key and text are looked at, so other columns can't clash. Keys are whole numbers.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.llm import blocks as B

LENGTH, GRAM = 400, 32
SYMBOL = 8  # bytes
UNIT = 1 << 17  # symbols in one collection, unless a single core has more
_POSITION_BITS = 27


class Segments:
    """All segments of a block's texts: first and last window, anchor, side and core hash."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(self.data)
        empty = np.empty(0, np.int64)
        self.first = self.last = self.anchor = empty
        self.core = np.empty(0, np.uint64)
        if n < length:
            return
        if n >= 1 << _POSITION_BITS:
            raise ValueError("a block of texts is too long for positions within it")
        up, down = B._powers(0, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        grams *= B._STEP[1]
        grams ^= grams >> np.uint64(32)
        grams *= B._STEP[0]
        low = np.uint64(_POSITION_BITS)
        least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
        width, reach = length - GRAM + 1, 1
        while reach * 2 <= width:  # the least of ever more neighbours
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: -(width - reach)], least[width - reach :])
        anchor = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        valid = np.zeros(len(anchor), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            valid[a : max(a, b - length + 1)] = True
        at = np.flatnonzero(valid)
        if not len(at):
            return
        half = (length - GRAM) // 2
        anchor = anchor[at]
        left = anchor - at > half
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1])
        first = np.flatnonzero(new)
        self.first, self.last = at[first], at[np.append(first[1:], len(at)) - 1]
        self.anchor, left = anchor[first], left[first]
        core_from = np.where(left, self.anchor - half - 1, self.anchor)
        core_to = np.where(left, self.anchor + GRAM, self.anchor + length - half)
        whole = (sums[core_to] - sums[core_from]) * down[core_from]
        self.core = B.mix(whole + left.astype(np.uint64))

    def candidates(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, "Strings"]:
        """Segments whose core is counted twice or more; the string of each; the distinct strings with their number."""
        seen = np.flatnonzero(codes[place] >= 2) if len(place) else place
        data = self.data.tobytes()
        found: dict[tuple[int, bytes], int] = {}
        string, number, cut = [], [], []
        spans = zip(self.first[seen].tolist(), (self.last[seen] + self.length).tolist(), self.core[seen].tolist(), self.anchor[seen].tolist())
        for a, b, core, anchor in spans:
            part = data[a:b]
            k = found.setdefault((core, xxhash.xxh3_128_digest(part)), len(number))
            if k == len(number):
                number.append(0)
                cut.append((part, core, (anchor - a) % SYMBOL))
            number[k] += 1
            string.append(k)
        order = sorted(range(len(cut)), key=lambda k: (cut[k][1], cut[k][0]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        strings = Strings(
            np.array([cut[k][1] for k in order], np.uint64),
            np.minimum([number[k] for k in order], 2**31 - 1).astype(np.int32) if order else np.empty(0, np.int32),
            np.array([cut[k][2] for k in order], np.uint8),
            np.array([len(cut[k][0]) for k in order], np.int32),
            b"".join(cut[k][0] for k in order),
        )
        return seen, rank[np.array(string, np.int64)] if string else np.empty(0, np.int64), strings


class Strings:
    """Strings in order of their cores: core, number of occurrences, phase of the grid, length, and the bytes."""

    _TYPES = (np.uint64, np.int32, np.uint8, np.int32)

    def __init__(self, core, number, phase, size, data: bytes):
        self.core, self.number, self.phase, self.size, self.data = core, number, phase, size, data
        self.ends = np.cumsum(size, dtype=np.int64)

    def between(self, a: int, b: int) -> "Strings":
        lo = int(self.ends[a - 1]) if a else 0
        hi = int(self.ends[b - 1]) if b else 0
        return Strings(self.core[a:b], self.number[a:b], self.phase[a:b], self.size[a:b], self.data[lo:hi])

    def each(self) -> Iterator[bytes]:
        lo = 0
        for hi in self.ends.tolist():
            yield self.data[lo:hi]
            lo = hi

    def pack(self) -> bytes:
        parts = [B.squeeze(x) for x in (self.core, self.number, self.phase, self.size)]
        parts.append(B.zstandard.ZstdCompressor(level=1).compress(self.data))
        return b"".join(len(x).to_bytes(8) + x for x in parts)

    @classmethod
    def unpack(cls, data: bytes) -> "Strings":
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8])
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        arrays = [B.expand(x, t) for x, t in zip(parts, cls._TYPES)]
        return cls(*arrays, B.zstandard.ZstdDecompressor().decompress(parts[-1]))


class _Files:
    """Arrays as external files, each read and written as a whole, in order."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def write(self, name: str, a: np.ndarray) -> None:
        """Over what the file held; no array gets shorter. (Some file systems wait for the disk when a file is cut.)"""
        path = self.folder / name
        with open(path, "r+b" if path.exists() else "wb") as f:
            a.tofile(f)

    def read(self, name: str, dtype: type) -> np.ndarray:
        return np.fromfile(self.folder / name, dtype)


def _least_between(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Answers for the least of ``values[a : b + 1]``, by a table of the least over powers of two."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))

    def ask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.log2(b - a + 1).astype(np.int64)
        out = np.empty(len(a), values.dtype)
        for k in np.unique(level).tolist():
            on = level == k
            out[on] = np.minimum(levels[k][a[on]], levels[k][b[on] - 2**k + 1])
        return out

    return ask


def suffix_order(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: owner, symbols left to the end, common prefix with the one before.

    ``strings`` hold symbols as whole numbers. Equal suffixes are in order of their strings. Common prefixes are
    counted up to 255."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    names, ids = np.unique(np.concatenate([*strings, np.empty(0, np.uint64)]), return_inverse=True)
    kind = np.uint16 if len(names) < 2**16 - 1 else np.uint32
    ids = (ids + 1).astype(kind)  # 0: nothing before this suffix
    ends = np.cumsum(sizes)
    with tempfile.TemporaryDirectory() as folder:
        files = _Files(folder)
        longest = int(sizes.max(initial=0))
        for j in range(longest + 1):  # column j: the symbol before the suffix of j symbols
            column = np.zeros(n, kind)
            has = sizes > j
            column[has] = ids[ends[has] - 1 - j]
            files.write(f"column{j}", column)
        files.write("before", files.read("column0", kind))
        files.write("common", np.zeros(n, np.uint8))
        files.write("owner", np.arange(n, dtype=np.int32))
        files.write("left", np.zeros(n, np.int32))
        at = np.arange(n)  # where the suffixes that were inserted last stand, by string
        active = np.flatnonzero(sizes > 0)
        for j in range(1, longest + 1):
            before = files.read("before", kind)
            order = np.argsort(before, kind="stable")  # suffixes by the symbol before them, then by themselves
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ended = int(np.searchsorted(before[order], 1))
            old = at[active]
            new = n + rank[old] - ended  # the place of symbol + suffix: all of its first symbol in the same order
            common = files.read("common", np.uint8)
            least = _least_between(common)
            r = rank[old]
            up, down = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
            has_up = (r > 0) & (before[up] == before[old])
            has_down = (r + 1 < len(order)) & (before[down] == before[old])
            with_up, with_down = np.zeros(len(old), np.uint8), np.zeros(len(old), np.uint8)
            with_up[has_up] = np.minimum(least(up[has_up] + 1, old[has_up]), 254) + 1
            with_down[has_down] = np.minimum(least(old[has_down] + 1, down[has_down]), 254) + 1
            total = len(before) + len(active)
            fresh = np.zeros(total, bool)
            fresh[new] = True

            def merged(name: str, dtype: type, values: np.ndarray) -> np.ndarray:
                out = np.empty(total, dtype)
                out[~fresh] = files.read(name, dtype)
                out[new] = values
                return out

            files.write("before", merged("before", kind, files.read(f"column{j}", kind)[active]))
            out = merged("common", np.uint8, with_up)
            out[new[has_down] + 1] = with_down[has_down]
            files.write("common", out)
            files.write("owner", merged("owner", np.int32, active.astype(np.int32)))
            files.write("left", merged("left", np.int32, np.full(len(active), j, np.int32)))
            at[active] = new
            active = active[sizes[active] > j]
        return files.read("owner", np.int32), files.read("left", np.int32), files.read("common", np.uint8)


def repeated_windows(strings: Strings, length: int = LENGTH) -> list[np.ndarray]:
    """For each string, whether the window that begins at each byte occurs twice or more in the collection.

    Windows of one string that are equal have equal anchors, so they are windows of two segments, and never of one."""
    out = [np.full(max(0, int(s) - length + 1), bool(k > 1)) for s, k in zip(strings.size, strings.number)]
    texts = list(strings.each())
    symbols = [np.frombuffer(t, "<u8", (len(t) - p) // SYMBOL, p) for t, p in zip(texts, strings.phase.tolist())]
    owner, left, common = suffix_order(symbols)
    whole = length // SYMBOL - 1  # symbols that lie inside every window from its first grid line on
    group = np.cumsum(common < whole)
    on = np.flatnonzero(left >= whole)
    owner, group = owner[on], group[on]
    counts = np.array([len(s) for s in symbols], np.int64)
    line = strings.phase[owner].astype(np.int64) + SYMBOL * (counts[owner] - left[on])
    pad = b"\0" * (2 * SYMBOL)
    joined = pad + pad.join(texts) + pad
    begins = np.cumsum([len(pad)] + [len(t) + len(pad) for t in texts])[:-1]
    eights = np.ndarray((len(joined) - SYMBOL + 1,), "<u8", joined, 0, (1,))
    place = begins[owner] + line
    tail_at = np.minimum(place + whole * SYMBOL, len(eights) - 1)
    head, tail = eights[place - SYMBOL], eights[tail_at]
    size = strings.size[owner].astype(np.int64)
    for r in range(SYMBOL):  # windows that begin r bytes before the grid line
        start = line - r
        ok = (start >= 0) & (start + length <= size)
        rest = tail if r == 0 else (head >> np.uint64(8 * (SYMBOL - r))) | (tail << np.uint64(8 * r))
        k = np.flatnonzero(ok)
        order = k[np.lexsort((rest[k], group[k]))]
        same = (group[order][1:] == group[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for i, a in zip(owner[order[twice]].tolist(), start[order[twice]].tolist()):
            out[i][a] = True
    return out


def _units(strings: Strings) -> Iterator[tuple[int, int]]:
    """Ranges of strings with whole cores, near UNIT symbols each."""
    n = len(strings.core)
    new = np.flatnonzero(np.append(True, strings.core[1:] != strings.core[:-1])) if n else np.empty(0, np.int64)
    lo, size = 0, 0
    for a, b in zip(new.tolist(), [*new[1:].tolist(), n]):
        more = int(strings.size[a:b].sum()) // SYMBOL
        if size and size + more > UNIT:
            yield lo, a
            lo, size = a, 0
        size += more
    if n:
        yield lo, n


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edge.astype(np.int32)


def _answer(rows: pa.Table, length: int) -> pa.Table:
    """For each string of each block the runs of windows that occur twice or more in the corpus."""
    got = [Strings.unpack(x) for x in rows["payload"].to_pylist()]
    number: dict[tuple[int, bytes], list] = {}
    named = []
    for g in got:
        keys = [(c, s) for c, s in zip(g.core.tolist(), g.each())]
        for key, k, phase in zip(keys, g.number.tolist(), g.phase.tolist()):
            number.setdefault(key, [0, phase])[0] += k
        named.append(keys)
    all_keys = sorted(number)
    alone: dict[int, int] = {}
    for core, _ in all_keys:
        alone[core] = alone.get(core, 0) + 1
    runs: dict[tuple[int, bytes], np.ndarray] = {}
    mixed = []
    for key in all_keys:
        if alone[key[0]] == 1:  # equal segments only: all of their windows occur as often as they do
            runs[key] = _runs(np.full(len(key[1]) - length + 1, number[key][0] > 1))
        else:
            mixed.append(key)
    strings = Strings(
        np.array([c for c, _ in mixed], np.uint64),
        np.minimum([number[k][0] for k in mixed], 2).astype(np.int32) if mixed else np.empty(0, np.int32),
        np.array([number[k][1] for k in mixed], np.uint8),
        np.array([len(s) for _, s in mixed], np.int32),
        b"".join(s for _, s in mixed),
    )
    for a, b in _units(strings):
        for key, flags in zip(mixed[a:b], repeated_windows(strings.between(a, b), length)):
            runs[key] = _runs(flags)
    payloads = []
    for keys in named:
        found = [runs[k] for k in keys]
        sizes = np.array([len(x) for x in found], np.int32)
        values = np.concatenate([*found, np.empty(0, np.int32)])
        payloads.append(B.squeeze(np.concatenate([np.array([len(sizes)], np.int32), sizes, values])))
    return pa.table({"part": rows["part"], "block": rows["block"], "payload": pa.array(payloads, pa.binary())})


def _answers(got: pa.Table) -> list[np.ndarray]:
    out = []
    for _, x in sorted(zip(got["part"].to_pylist(), got["payload"].to_pylist())):
        values = B.expand(x, np.int32)
        n = int(values[0])
        out += np.split(values[1 + n :], np.cumsum(values[1 : 1 + n])[:-1]) if n else []
    return out


def _removed(docs: DataFrame, key: str, text: str, length: int, finish: Callable[[bytes], object], kind: str) -> DataFrame:
    if length % SYMBOL or length < 2 * GRAM:
        raise ValueError(f"the length is a multiple of {SYMBOL} and {2 * GRAM} at least")
    shape = B.layout(docs, text, 96.0)
    rows = B.dealt(docs, key, text, shape)
    bits = np.uint64(64 - shape.bits)
    parts_of = np.uint64(64 - shape.range_bits - 3)

    def sketch(block: int, table: pa.Table) -> pa.Table:
        values, times, _ = B.distinct(Segments(list(B.encoded(table)), length).core >> bits)
        return B.requests(block, values, times, shape)

    def look(table: pa.Table, got: pa.Table):
        x = Segments(list(B.encoded(table)), length)
        _, _, place = B.distinct(x.core >> bits)
        return x, *x.candidates(B.answer_for(got), place)

    def send(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        _, _, _, strings = look(table, got)
        parts = (strings.core >> parts_of).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts)) + 1
        lows, highs = [0, *cuts.tolist()], [*cuts.tolist(), len(parts)]
        return B.request_table(block, [(int(parts[a]), strings.between(a, b).pack()) for a, b in zip(lows, highs) if b > a])

    def remove(block: int, table: pa.Table, got: pa.Table) -> pa.Table:
        second = got["second"].to_numpy(zero_copy_only=False).astype(bool)
        x, seen, string, _ = look(table, got.filter(pa.array(~second)))
        runs = _answers(got.filter(pa.array(second)))
        edge = np.zeros(len(x.data) + 1, np.int32)
        if runs:
            sizes = np.array([len(r) for r in runs], np.int64)
            begin = np.cumsum(sizes) - sizes
            values = np.concatenate(runs).astype(np.int64)
            per = sizes[string] // 2
            which = np.repeat(begin[string], per) + 2 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            base = np.repeat(x.first[seen], per)
            np.add.at(edge, base + values[which], 1)
            np.add.at(edge, base + values[which + 1] - 1 + length, -1)
        covered = np.cumsum(edge)[:-1] > 0
        sums = np.append(0, np.cumsum(covered))
        n_removed = sums[x.ends] - sums[x.starts]
        run_starts = covered.copy()
        run_starts[1:] &= ~covered[:-1]
        inner = x.starts[(x.starts < len(covered)) & (x.ends > x.starts)]
        run_starts[inner] = covered[inner]
        spans = np.append(0, np.cumsum(run_starts))
        n_spans = spans[x.ends] - spans[x.starts]
        out = []
        for a, b, n in zip(x.starts.tolist(), x.ends.tolist(), n_removed.tolist()):
            part = x.data[a:b]
            out.append(finish((part[~covered[a:b]] if n else part).tobytes()))
        return pa.table(
            {
                "key": table["key"],
                "no_key": table["no_key"],
                "n_bytes": pa.array(x.ends - x.starts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "out": pa.array(out, pa.binary() if kind == "binary" else pa.string()),
            }
        )

    answers = B.answered(B.each_block(rows, sketch, B.REQUEST))
    sent = B.with_answers(rows, answers, send, B.REQUEST)
    found = sent.groupBy("part").applyInArrow(lambda t: _answer(t, length), B.REQUEST)
    both = answers.withColumn("second", F.lit(False)).unionByName(found.withColumn("second", F.lit(True)))
    schema = f"key long, no_key boolean, n_bytes long, n_removed long, n_spans long, out {kind}"
    out = B.with_answers(rows, both, remove, schema)
    return out.select(F.when(~F.col("no_key"), F.col("key")).alias(key), "n_bytes", "n_removed", "n_spans", "out")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans (runs that went) and kept, the bytes that stay."""
    return _removed(docs, key, text, length, lambda kept: kept, "binary").withColumnRenamed("out", "kept")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The same with kept_sha256, the digest of the bytes that stay."""
    found = _removed(docs, key, text, length, lambda kept: hashlib.sha256(kept).hexdigest(), "string")
    return found.withColumnRenamed("out", "kept_sha256")
