"""Plain versions of the operators, and rows with all that may go wrong."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, ties, and a long text."""
    rnd = random.Random(11)
    words = [f"w{i}é" for i in range(50)]
    long = " ".join(rnd.choice(words) for _ in range(20_000))
    some = " ".join(words[:30])
    return [
        (1, some), (2, None), (3, ""), (4, " \n\t "), (5, some), (5, some), (6, long), (None, some), (None, None),
        (7, "one"), (8, "one two"), (9, some + " tail"), (10, long[: len(long) // 2]), (11, "x" * 2000), (12, "ab " * 500),
    ]


def with_clashes(df):
    """Columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    for c in "block part key n row node size shard slot kept score ids offsets spans stratum c w h fp license path lang".split():
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def repeated_words(rows: list[tuple], length: int) -> dict:
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    for i in order:
        w = WORD.findall(rows[i][1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if g in seen:
                gone[k : k + length] = [True] * length
            seen.add(g)
        out.append((rows[i][0], len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y)))
    return Counter(out)


def repeated_bytes(rows: list[tuple], length: int) -> Counter:
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y)))
    return Counter(out)


def components(rows: list[tuple], percent: int = 90, shingle: int = 3) -> Counter:
    """(key, set size, least key of the component) of each row, null keys as the least."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    at = list(range(len(rows)))

    def find(x: int) -> int:
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                at[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        k = -1 if key is None else key
        least[find(i)] = min(least.get(find(i), k), k)
    shown = lambda i: None if least[find(i)] == -1 else least[find(i)]
    return Counter((rows[i][0], len(sets[i]), shown(i)) for i in range(len(rows)))
