"""Repeats, near copies, benchmark passages: against plain versions on small rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from demandry.llm import blocks, decontam, jaccard, repeats, suffixes
from demandry.llm.components import roots
from plain import components, odd_rows, repeated_bytes, repeated_words, with_clashes

SCHEMA = "doc_id long, text string"


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20_000)


def edited(seed: int, n: int, words: int = 120) -> list[tuple]:
    """Groups of texts that differ by a few words, and some that differ by none."""
    rnd = random.Random(seed)
    bases = [[f"{rnd.choice('abcdefgh')}{rnd.randrange(300)}" for _ in range(rnd.randrange(3, words))] for _ in range(n // 8 + 1)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    return rows


def test_packed_hashes_come_back():
    rng = np.random.default_rng(3)
    for bits in (10, 33, 62):
        values = np.unique(rng.integers(0, 2**bits, 500).astype(np.uint64))
        weights = rng.integers(1, 256, len(values)).astype(np.uint8)
        got = blocks.unpack(blocks.pack(values, weights))
        assert (got[0] == values).all() and (got[1] == weights).all()
    codes = blocks.code(np.arange(1, 100_000))
    assert (np.diff(codes.astype(int)) >= 0).all() and codes[:3].tolist() == [1, 2, 3]


@pytest.mark.parametrize("rows", [odd_rows(), edited(1, 60)], ids=["odd", "edited"])
def test_repeated_word_windows(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(df).collect())
    assert got == repeated_words(rows, repeats.WINDOW)


def test_suffix_order():
    rnd = random.Random(3)
    for trial in range(60):
        texts = [[rnd.randrange(1 + trial % 4) for _ in range(rnd.randrange(12))] for _ in range(rnd.randrange(1, 8))]
        owner, left, common = suffixes.suffix_order([np.array(t, np.uint64) for t in texts])
        want = sorted((tuple(t[len(t) - k :]), i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
        assert list(zip(owner.tolist(), left.tolist())) == [(i, k) for _, i, k in want]
        for x in range(1, len(want)):
            a, b = want[x - 1][0], want[x][0]
            same = next((n for n, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert common[x] == same


@pytest.mark.parametrize("rows", [odd_rows(), edited(2, 60), [(i, ("ab" * 70)[i % 3 :] + "c" * (i * 20)) for i in range(9)]], ids=["odd", "edited", "periods"])
def test_repeated_bytes(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = suffixes.remove_repeats(df, length=64).collect()
    found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    assert found == repeated_bytes(rows, 64)


def test_planted_passages(spark):
    """At the length of the contract a passage of over 50 words goes from every document that has it, from the first too; one under 400 bytes stays."""
    rnd = random.Random(11)

    def words(n: int) -> str:
        return " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(10_000, 100_000)}" for _ in range(n))

    long, short = words(70), words(52)
    assert len(short) < 390 and len(long) > 400
    rows = [(i, " ".join((words(200), part, words(200)))) for i, part in enumerate((long, long, short, short, words(70), words(52), long))]
    df = spark.createDataFrame([*rows, (7, None)], SCHEMA)
    want = Counter((k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, n, gone, spans, kept in repeated_bytes([*rows, (7, None)], suffixes.LENGTH).elements())
    got = suffixes.digests(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == want
    assert {r["doc_id"] for r in got if r["n_removed"]} == {0, 1, 6}
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {**{k: len(t) for k, t in rows}, 7: 0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    for out in (repeats.digests(none), suffixes.digests(none), jaccard.components(none), decontam.report(none, items)):
        assert out.count() == 0


@pytest.mark.parametrize("seed,words", [(5, 120), (6, 30), (7, 12)])
def test_components_of_near_copies(spark, seed, words):
    rows = edited(seed, 120, words)
    got = Counter(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == components(rows)


def test_components_at_other_thresholds(spark):
    rows = edited(9, 100, 60)
    for percent, shingle in ((80, 5), (60, 2), (100, 3)):
        got = Counter(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA), shingle=shingle, percent=percent).collect())
        assert got == components(rows, percent, shingle), (percent, shingle)


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError, match="50"):
        jaccard.components(spark.createDataFrame([], SCHEMA), percent=40)


def test_lists_hold_as_much_for_long_sets_as_for_short_ones():
    """An entry's parities have one width; a lower bound of the difference all the same."""
    rng = np.random.default_rng(8)
    for n in (50, 400, 20_000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)])
        fold = [jaccard._parity(x, 64 * jaccard.FOLD) for x in (a, b)]
        assert len(fold[0]) == jaccard.FOLD
        assert np.unpackbits((fold[0] ^ fold[1]).view(np.uint8)).sum() <= 2 * (n // 10)


def test_components_of_odd_rows(spark):
    rows = odd_rows()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in jaccard.components(df).collect()) == components(rows)
    stay = jaccard.representatives(df)
    assert set(stay.columns) == set(df.columns)
    # 1, 5 and a null key have one text, and 9 is near it: the null key stands for them. Blank rows all stay.
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(["None", "None", "2", "3", "4", "6", "7", "8", "10", "11", "12"])


def test_representatives_when_keys_repeat(spark):
    """One row of each group stays, told apart by key and text."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c, d = " ".join(f"c{i}" for i in range(60)), " ".join(f"d{i}" for i in range(60))
    rows = [(3, a), (5, a + " x"), (5, b), (7, c), (7, c + " x"), (None, d), (None, d + " x"), (9, d + " y"), (5, b), (None, None), (None, None)]
    for order in (rows, rows[::-1]):
        df = with_clashes(spark.createDataFrame(order, SCHEMA))
        stay = [(r["doc_id"], r["text"]) for r in jaccard.representatives(df).collect()]
        groups = sorted((str(k), (t or "none")[0]) for k, t in stay)
        assert groups == [("3", "a"), ("5", "b"), ("7", "c"), ("None", "d"), ("None", "n")]
        assert (3, a) in stay and (5, b) in stay


def test_boundaries_link_the_same(spark, monkeypatch):
    rows = edited(8, 100, 40)
    want = components(rows)
    for boundary in (0, 15, 28):
        monkeypatch.setattr(jaccard, "choose_boundary", lambda held, t, b=boundary: b)
        got = Counter(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == want, boundary


def test_roots_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r["node"]: r["root"] for r in roots(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def plain_hits(docs: list[tuple], items: list[tuple]) -> Counter:
    import re

    from plain import LOWER

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), ",".join(ids), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("bound", [decontam.BROADCAST_FINGERPRINTS, 0])
def test_benchmark_windows(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_FINGERPRINTS", bound)
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(n))
    items = [(i, text(rnd.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "!!"), (52, "Only, Four; Words Here"), (None, "nobody knows this"), (3, "Only four words here")]
    docs = [(i, text(60).upper() if i % 3 else text(15)) for i in range(12)]
    docs += [(20 + i, text(5) + " " + (items[i][1] or "") + " " + text(4)) for i in range(12)] + odd_rows()
    docs += [(90, "so nobody knows this"), (91, "only FOUR words-here")]
    df = with_clashes(spark.createDataFrame(docs, SCHEMA))
    bench = with_clashes(spark.createDataFrame(items, "item_id int, text string"))
    got = decontam.report(df, bench).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got)
    want = plain_hits(docs, items)
    assert found == want
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(k for r, k in want.items() if not r[-1])
    assert decontam.report(df, bench.limit(0)).where("contaminated").count() == 0
