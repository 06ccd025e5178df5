"""Id files, periodic runs and Merkle trees against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandry.llm import idfiles, manifest, periodic
from demandry.llm.common import table
from demandry.llm.queries import QUERIES, tokenizer_file
from demandry.session import fresh_path
from plain import LOWER, odd_rows, sha, with_clashes

DOCS = "doc_id long, text string"


# --- id files ---


def plain_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


BLANKS = ["a  b", " a", "a ", "  a b  ", "a\n b \n c", "a b\n\n", "é ü x y", "x" * 200 + " y " + "z" * 100, "tail <|endoftext|> of text<|endoftext|>",
          "don't we'll it's", "a\tb c d e", "1 22 3,3 ...", "日本 語の テキスト", "\x1c a \x1f b", " ", "\n", "a\n", "b \n"]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(idfiles, "SPAN", 50)
    monkeypatch.setattr(idfiles, "KNOWN", 10)
    monkeypatch.setattr(idfiles, "TOGETHER", 3)
    rnd = random.Random(3)
    signs = ["a", "b", "C", " ", " ", "\n", "1", ".", "'s", "é", "日", " ", "<|endoftext|>", "\t"]
    texts = [*BLANKS, *["".join(rnd.choice(signs) for _ in range(rnd.randrange(200))) for _ in range(500)]]
    ids = idfiles.Encoder(tokenizer_file())
    assert ids.by_word
    got = [[*np.frombuffer(x, ids.dtype).tolist(), 0] for x in ids.encode(texts)]
    assert got == plain_ids(texts)


def test_plain_words_go_to_the_model_alone(monkeypatch):
    rnd = random.Random(4)
    signs = ["a", "Z", "e", "é", "Ö", "ɏ", "ß", ".", "-", "##", "(", "~", "`"]
    texts = ["first " + " ".join("".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 9))) for _ in range(300)) + " last" for _ in range(20)]
    odd = ["a don't b'. c", "a x\u00d7y \u00f7 z", "a b1 c2. d", "a x<|endoftext|>. y", "a \u0250q", "a q\u0301."]
    ids = idfiles.Encoder(tokenizer_file())
    asked = []
    whole = ids._whole
    monkeypatch.setattr(ids, "_whole", lambda some: (asked.extend(some), whole(some))[1])
    got = [[*np.frombuffer(x, ids.dtype).tolist(), 0] for x in ids.encode([*texts, *odd])]
    assert got == plain_ids([*texts, *odd])
    assert not [w for x in asked for w in x.split()[1:] if idfiles._PLAIN.fullmatch(w)]
    assert idfiles.crowded("a  b") and idfiles.crowded("a\u2003 b") and idfiles.crowded("a \nb") and not idfiles.crowded("a b\nc d")


def test_files_hold_the_ids_in_order_of_keys(spark, monkeypatch):
    rows = [*odd_rows(), *[(100 + i, t) for i, t in enumerate(BLANKS)]]
    folder = fresh_path(spark, "ids")
    index = idfiles.write(with_clashes(spark.createDataFrame(rows, DOCS)), folder, tokenizer_file())
    got = idfiles.read(index, folder).collect()
    want = Counter(zip([k for k, _ in rows], map(tuple, plain_ids([t for _, t in rows]))))
    assert Counter((r["key"], tuple(r["ids"])) for r in got) == want
    got.sort(key=lambda r: (r["start"], r["n_tokens"]))
    keys = [-1 if r["key"] is None else r["key"] for r in got]
    assert keys == sorted(keys)
    assert [r["start"] for r in got] == np.cumsum([0, *[len(r["ids"]) for r in got]])[:-1].tolist()
    few = idfiles.lookup(spark, folder, spark.createDataFrame([(7,), (5,), (999,)], "key long")).collect()
    assert Counter((r["key"], tuple(r["ids"])) for r in few) == Counter({x: n for x, n in want.items() if x[0] in (5, 7)})


def test_small_files_are_ended_and_a_foreign_dictionary_is_refused(spark, monkeypatch):
    rows = [(i, " ".join(f"word{i * k % 17}" for k in range(50))) for i in range(200)]
    folder = fresh_path(spark, "ids")
    index = idfiles.write(spark.createDataFrame(rows, DOCS), folder, tokenizer_file(), end_id=7, dictionary=b"")
    got = {r["key"]: r["ids_crc32"] for r in idfiles.checksums(index, folder).collect()}
    assert got == {k: crc([*x[:-1], 7]) for (k, _), x in zip(rows, plain_ids([t for _, t in rows]))}
    writer = idfiles._Writer(folder, 0, 2, b"")
    monkeypatch.setattr(idfiles, "FILE_BYTES", 150)
    places = [writer.add(b"x" * 60) for _ in range(4)]
    writer.close()
    assert [offset for _, offset in places] == [41, 101, 41, 101] and len({f for f, _ in places}) == 2
    other = fresh_path(spark, "ids")
    idfiles.write(spark.createDataFrame(rows[:3], DOCS), other, tokenizer_file(), dictionary=b"another dictionary of bytes")
    foreign = spark.read.parquet(f"{other}/dictionary").first()["sha256"]
    fs, local = idfiles._place(f"{folder}/data")
    with pytest.raises(ValueError, match="dictionary"):
        idfiles._checked(fs.open_input_file(f"{local}/{index.first()['file']}"), bytes.fromhex(foreign))


def test_dictionary_is_trained_and_shared(spark, sf):
    docs = table(spark, sf, "documents")
    shared = idfiles.train(docs, tokenizer_file())
    assert 0 < len(shared) <= idfiles.DICTIONARY_BYTES
    assert shared == idfiles.train(docs.repartition(5), tokenizer_file())


def test_no_rows_no_files(spark):
    folder = fresh_path(spark, "ids")
    index = idfiles.write(spark.createDataFrame([], DOCS), folder, tokenizer_file())
    assert idfiles.checksums(index, folder).count() == 0


def test_op11_on_the_whole_table(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    ids = plain_ids([t for _, t in rows])
    starts = np.cumsum([0, *[len(x) for x in ids]]).tolist()
    got = sorted(map(tuple, QUERIES["op11_id_files"](spark, sf).collect()))
    assert got == [(k, s, len(x), crc(x)) for (k, _), s, x in zip(rows, starts, ids)]


# --- periodic runs ---


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(w[i : i + size - r] == w[i + r : i + size] for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def lyndon(s):
    def longest(i):
        return max(j for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j)))

    return [longest(i) - i for i in range(len(s))]


def test_grouping_gives_the_longest_lyndon_words():
    rnd = random.Random(5)
    for _ in range(400):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randrange(14))]
        assert periodic.lyndon_lengths(s) == lyndon(s)


def _texts(rnd):
    for _ in range(150):
        k, n = rnd.choice([1, 2, 3, 30]), rnd.randrange(70)
        w = [f"w{rnd.randrange(k)}" for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            if n > 10:
                a, b, p = rnd.randrange(n), rnd.randrange(n), rnd.randrange(1, 7)
                for i in range(a, b):
                    w[i] = w[a + (i - a) % p]
        yield rnd.choice([" ", "\n", "\t  "]).join(w)


def _want_runs(rows):
    want = Counter()
    for key, t in rows:
        w = (t or "").encode().decode().translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        runs = plain_runs(w) if len(w) < 1000 else None
        want[(key, len(w), None if runs is None else tuple(runs), None if runs is None else collapsed(w, runs))] += 1
    return want


def test_runs_as_found_by_every_period(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 300)
    rows = [*odd_rows(), *enumerate(_texts(random.Random(9)), start=100), (50, "la " * 6), (51, "la " * 5), (52, "a b " * 4), (53, "a b " * 3 + "a")]
    rows = [(k, t) for k, t in rows if len((t or "").split()) < 1000]
    out = periodic.runs(with_clashes(spark.createDataFrame(rows, DOCS))).collect()
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in out)
    assert got == _want_runs(rows)


def test_long_texts_with_long_periods():
    rnd = random.Random(2)
    w = [rnd.randrange(10**6) for _ in range(30_000)]
    both = np.array([*w[:500], *(w[1000:8000] * 4), *w[9000:9100], *([7, 8, 7] * 50)])
    runs = periodic.find_runs(both, np.array([0]))
    assert runs.tolist() == [[500, 28_000, 7000], [28_600, 150, 3]]


def test_alike_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(periodic, "_PRIMES", ((2, 1),))  # almost everything looks alike
    rnd = random.Random(4)
    for _ in range(60):
        w = [rnd.randrange(2) for _ in range(40)]
        got = [tuple(r) for r in periodic.find_runs(np.array(w), np.array([0])).tolist()]
        assert set(got) <= set(plain_runs(w))


def test_runs_of_no_rows(spark):
    assert periodic.runs(spark.createDataFrame([], DOCS)).count() == 0


def test_op12_on_the_whole_table(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for key, text in rows:
        w = [x for x in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        h, n = zlib.crc32(str(key).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = plain_runs(w) if n < 3000 else None
        if runs is None:
            continue
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        some += top is not None
        first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        assert got[key] == (len(runs), *first, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(w, runs))), key
    assert some > 5


# --- Merkle trees ---


def tree(level):
    """Root, and the siblings of each node by level."""
    paths, own = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(own):
            a = i // 8 * 8
            paths[k].append((level[a:i], level[i + 1 : a + 8]))
        level = [sha("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        own = [i // 8 for i in own]
    return level[0], paths


def plain_tree(rows):
    """rows: (group, key, digest). For each: subroot, root, digest of the siblings."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([r[2] for r in groups[g]]) for g in order}
    root, tops = tree([subs[g][0] for g in order])
    out = Counter()
    for g, top in zip(order, tops):
        for r, path in zip(groups[g], subs[g][1]):
            out[(*r, subs[g][0], root, sha("".join("".join(a + b) for a, b in [*path, *top])))] += 1
    return out


def proved(spark, rows):
    df = with_clashes(spark.createDataFrame(rows, "g string, k long, d string"))
    out = manifest.proofs(df, "k", "g", "d", carry=["n"])
    return out.select("*", manifest.proof_digest(F.col("path")).alias("proof"), manifest.fold(F.col("leaf"), F.col("path")).alias("folded"))


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 65, 3, 1, 1, 1, 1, 1, 1], [513, 2, 512, 1300, 5]])
def test_proofs_as_in_a_plain_tree(spark, sizes):
    names = [None, "", "b", "a", "é", "zz", "Z", "日", "c"]
    rows = [(names[i], k // 3 if k % 50 else None, sha(f"{i}:{k // 2}")) for i, n in enumerate(sizes) for k in range(n)]
    got = proved(spark, rows).collect()
    assert Counter((r["g"], r["k"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain_tree(rows)
    assert all(r["folded"] == r["root"] and r["n"] == "clash" for r in got)


def test_nodes_above_one_round_of_blocks(spark, monkeypatch):
    """Two factors of 512 by smaller blocks: three levels of blocks."""
    monkeypatch.setattr(manifest, "ROUND", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [("a", k, sha(str(k))) for k in range(700)] + [("b", k, sha(str(k))) for k in range(65)]
    got = proved(spark, rows).collect()
    assert Counter((r["g"], r["k"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == plain_tree(rows)


def test_a_changed_row_does_not_lead_to_the_root(spark):
    rows = [("a", k, sha(str(k))) for k in range(20)]
    out = proved(spark, rows).withColumn("wrong", manifest.fold(F.sha2(F.lit("x").cast("binary"), 256), F.col("path")))
    assert all(r["wrong"] != r["root"] for r in out.collect())


def test_leaf_tells_null_empty_and_neighbours_apart(spark):
    rows = [(1, None, "a"), (1, "", "a"), (1, "a", ""), (None, "a", ""), (1, "1:a", "é")]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b string, c string").select(manifest.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert got == [sha("".join(map(field, r))) for r in rows] and len(set(got)) == 5


def test_tree_of_no_rows(spark):
    assert proved(spark, []).count() == 0


def test_op13_tampering_is_found(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in QUERIES["op13_merkle_manifest"](spark, sf).collect():
        t = texts[r["doc_id"]]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and t is not None and t.translate(LOWER) != t
        assert r["verified"] is not changed and (r["folded_root"] == r["root"]) is not changed
