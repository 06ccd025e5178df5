"""Runs of periodically repeated words, found through Lyndon words.

A run is a stretch of words that repeats with a least period q, that no neighbouring word extends, and that is long
enough: ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods. Each run has a root, a Lyndon word under an order of the words or under
the opposite order, that is the longest Lyndon word at its place. ``lyndon_lengths`` finds the longest Lyndon word at every place with
the grouping phase of Baier's suffix sorting: suffixes are grouped by their first word; groups are taken from the highest down, and
each splits the groups of the nearest suffixes before its own that stand lower, whose common prefixes grow by its
own. What the suffixes of a group have in common in the end is their longest Lyndon prefix. Under both orders, each such root is
extended to both sides as far as words a period apart agree (common extensions by prefix sums of two hashes, then compared
word by word), and long enough stretches are the runs.

Only stretches of words that can lie in a run are grouped: any three neighbouring words of a run stand at least three times in
it, so stretches between rarer triples are left out beforehand, which loses no run.

Texts are worked on one by one in Arrow batches; nothing is shuffled. Memory is linear in the longest text (some 150 bytes
a word) and otherwise that of ``TOGETHER`` words.

* null text: no words, no runs, an empty collapsed text. Null keys and repeated rows: one result each. Empty table: no rows.
* Runs of several periods may overlap; each is returned. A word goes if any run holds it after that run's first period.
* Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEAST_WORDS, LEAST_TIMES = 6, 4
TOGETHER = 500_000
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place."""
    n = len(symbols)
    kinds = {s: g for g, s in enumerate(sorted(set(symbols)))}
    of = [kinds[s] for s in symbols]  # the group of each suffix; groups are linked in their order
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(of):
        members[g].append(i)
    common = [1] * len(kinds)  # words that the suffixes of a group begin with
    size = [len(m) for m in members]
    lower, higher = [g - 1 for g in range(len(kinds))], [g + 1 for g in range(len(kinds))]
    before = list(range(-1, n - 1))
    taken = bytearray(n)
    g = len(kinds) - 1
    while g >= 0:
        here = [i for i in members[g] if of[i] == g]
        members[g] = []
        for i in here:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in here:
            p = before[i]
            while p >= 0 and taken[p]:
                p = before[p]
            before[i] = p  # the nearest one in a lower group
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            parts.setdefault((-k, of[p]), []).append(p)
        for (k, h), moved in sorted(parts.items(), key=lambda x: x[0]) if len(parts) > 1 else parts.items():
            longer = common[h] - k * common[g]
            if len(moved) == size[h]:
                common[h] = longer
                continue
            new = len(common)
            size[h] -= len(moved)
            common.append(longer)
            size.append(len(moved))
            members.append(moved)
            for p in moved:
                of[p] = new
            lower.append(h)
            higher.append(higher[h])
            lower[higher[h]] = new
            higher[h] = new
        g = lower[g]
    return [common[x] for x in of]


_PRIMES = ((2147483647, 1103515245), (2147483629, 69069))


class _Extensions:
    """How far two places of a sequence agree, to the right and to the left."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n, self.sums, self.powers = n, [], []
        for prime, base in _PRIMES:
            power = np.ones(n + 1, np.uint64)
            done, step = 1, base
            while done <= n:
                some = min(done, n + 1 - done)
                power[done : done + some] = power[:some] * np.uint64(step) % np.uint64(prime)
                done, step = done + some, step * step % prime
            terms = (symbols.astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(prime) + np.uint64(1)) * power[:n] % np.uint64(prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(prime))
            self.powers.append(power)

    def _same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` symbols from a (before b) and from b are alike."""
        same = np.ones(len(a), bool)
        for (prime, _), sums, power in zip(_PRIMES, self.sums, self.powers):
            m = np.uint64(prime)
            left = (sums[a + size] + m - sums[a]) % m * power[b - a] % m
            same &= left == (sums[b + size] + m - sums[b]) % m
        return same

    def both(self, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols alike from a and b on, and before a and b; at most ``most`` and a bit."""
        right, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for k in range(max(most, 1).bit_length(), -1, -1):
            size = 1 << k
            on = np.flatnonzero(b + right + size <= self.n)
            on = on[self._same(a[on] + right[on], b[on] + right[on], size)]
            right[on] += size
            on = np.flatnonzero(a - left - size >= 0)
            on = on[self._same(a[on] - left[on] - size, b[on] - left[on] - size, size)]
            left[on] += size
        return left, right


def _stretches(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the stretches that can hold runs; ``first`` are the places at which texts begin.

    No symbol stands in two texts. A triple counts within a stretch, so the count is taken again in what is left.
    """
    n = len(symbols)
    owner = np.zeros(n, np.int64)
    owner[first[first < n]] = 1
    owner = np.cumsum(owner).astype(np.uint64)
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
    at = np.arange(n)
    starts = ends = np.empty(0, np.int64)
    for _ in range(4):
        inside = at[:-2][(at[2:] - at[:-2] == 2) & (owner[at[2:]] == owner[at[:-2]])] if len(at) > 2 else at[:0]
        keys = owner[inside] * mult[0]
        for k in range(3):
            keys = (keys ^ (keys >> np.uint64(29))) * mult[k + 1] + symbols[inside + k].astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.empty(0, np.int64)
        times = np.diff(np.append(new, len(keys)))
        often = np.zeros(len(keys), bool)
        often[order] = np.repeat(times >= 3, times)
        kept = np.zeros(n, bool)
        for k in range(3):
            kept[inside[often] + k] = True
        places = np.flatnonzero(kept)
        split = np.ones(len(places), bool)
        if len(places):
            split[1:] = (np.diff(places) > 1) | (owner[places[1:]] != owner[places[:-1]])
        begin = np.flatnonzero(split)
        count = np.diff(np.append(begin, len(places)))
        starts, ends = places[begin], places[begin] + count
        long = count >= LEAST_WORDS
        places = places[np.repeat(long, count)]
        starts, ends = starts[long], ends[long]
        if len(places) == len(at):
            break
        at = places
        owner = np.zeros(n, np.uint64)
        owner[at] = np.repeat(np.arange(1, len(starts) + 1, dtype=np.uint64), ends - starts)
    return starts, ends


def _exact(symbols: np.ndarray, a: int, period: int) -> tuple[int, int]:
    """The stretch around a in which symbols a period apart agree, by comparing symbols."""
    lo, hi = a, a
    while lo > 0 and symbols[lo - 1] == symbols[lo - 1 + period]:
        lo -= 1
    while hi + period < len(symbols) and symbols[hi] == symbols[hi + period]:
        hi += 1
    return lo, hi + period


def _has_shorter(symbols: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a stretch of two periods or more repeats with a shorter period as well, which then divides it."""
    return any(period % r == 0 and np.array_equal(symbols[start : end - r], symbols[start + r : end]) for r in range(1, period // 2 + 1))


def find_runs(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of texts that lie one after another, in order of start and period."""
    starts, ends = _stretches(symbols, first)
    if not len(starts):
        return np.empty((0, 3), np.int64)
    sizes = ends - starts
    # The stretches one after another, each with a symbol of its own behind it.
    base = np.append(0, np.cumsum(sizes + 1))[:-1]
    packed = np.empty(int(sizes.sum() + len(sizes)), np.int64)
    packed[base + sizes] = -1 - np.arange(len(sizes))
    inside = np.ones(len(packed), bool)
    inside[base + sizes] = False
    origin = np.repeat(starts - base, sizes + 1)
    packed[inside] = symbols[(np.arange(len(packed)) + origin)[inside]]
    root = np.zeros((2, len(packed)), np.int64)
    for b, size in zip(base.tolist(), sizes.tolist()):
        ranked = np.unique(packed[b : b + size], return_inverse=True)[1]
        root[0, b : b + size] = lyndon_lengths(ranked.tolist())
        root[1, b : b + size] = lyndon_lengths((-ranked).tolist())
    last = np.repeat(base + sizes, sizes + 1)
    found = []
    extensions = _Extensions(np.unique(packed, return_inverse=True)[1])
    for lengths in root:
        a = np.flatnonzero((lengths > 0) & (LEAST_TIMES * lengths <= np.repeat(sizes, sizes + 1)))
        a = a[a + lengths[a] < last[a]]
        period = lengths[a]
        near = (packed[a] == packed[a + period]) | (packed[np.maximum(a - 1, 0)] == packed[np.maximum(a - 1, 0) + period])
        a, period = a[near], period[near]
        left, right = extensions.both(a, a + period, int(sizes.max()))
        long = left + right + period >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(np.stack([a[long] - left[long], (left + right + period)[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    sure = []
    for s, length, q in runs.tolist():
        e = s + length
        if not np.array_equal(packed[s : e - q], packed[s + q : e]):  # hashes agreed where symbols do not
            wrong = np.flatnonzero(packed[s : e - q] != packed[s + q : e])
            edges = np.append(np.append(-1, wrong), e - q - s)
            pieces = [_exact(packed, s + int(x) + 1, q) for x in edges[:-1] if int(x) + 1 < e - q - s]
            pieces = [(x, y) for x, y in pieces if y - x >= LEAST_TIMES * q and not _has_shorter(packed, x, y, q)]
        else:
            pieces = [(s, e)]
        sure += [(x + origin[x], y - x, q) for x, y in pieces if y - x >= max(LEAST_WORDS, LEAST_TIMES * q)]
    out = np.array(sorted(set(sure)), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _together(texts: list[str | None]) -> Iterator[list[tuple[list[bytes], np.ndarray]]]:
    """Words of some texts at a time, and a number for each different word of a text."""
    held, n = [], 0
    for t in texts:
        words = (t or "").encode().split()  # at the six white-space signs of ASCII
        numbers: dict[bytes, int] = {}
        held.append((words, np.fromiter(map(numbers.setdefault, words, range(len(words))), np.int64, len(words))))
        n += len(words)
        if n >= TOGETHER:
            yield held
            held, n = [], 0
    if held:
        yield held


def _analysed(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    for some in _together(texts):
        first = np.cumsum([0, *[len(w) for w, _ in some]])
        runs = find_runs(np.concatenate([ids + at for (_, ids), at in zip(some, first)]), first[:-1])
        cuts = np.searchsorted(runs[:, 0], first)
        for (words, _), at, a, b in zip(some, first.tolist(), cuts, cuts[1:]):
            own = [(s - at, length, q) for s, length, q in runs[a:b].tolist()]
            if own:
                kept = np.ones(len(words), bool)
                for s, length, q in own:
                    kept[s + q : s + length] = False
                words_left = compress(words, kept.tolist())
            else:
                words_left = words
            yield len(words), own, b" ".join(words_left)


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (in order of start and period) and collapsed: the text without what runs repeat."""
    out = StructType([docs.schema[key], *StructType.fromDDL(f"n_words bigint, {RUNS}, collapsed string").fields])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, left = [], [], []
            for size, own, collapsed in _analysed(batch.column(1).to_pylist()):
                n.append(size)
                found.append([{"start": s, "length": x, "period": q} for s, x, q in own])
                left.append(collapsed.decode())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, out.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(work, out)
