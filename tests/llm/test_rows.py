"""Rules, shards, licences and the pipeline."""

from __future__ import annotations

from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from demandry.llm import licenses, rules, sharding
from demandry.llm.common import table
from plain import WORD, odd_rows, with_clashes

SCHEMA = "doc_id long, text string"


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, share) for n in (1, 7, 40, 300) for k in (0, 1, 2, 5) for share in (0.01, 0.2) if k <= n]
    for share in (0.01, 0.2):
        df = spark.createDataFrame([(k, n) for k, n, s in cases if s == share], "k long, n long")
        for r in df.select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), share).alias("p")).collect():
            want = sum(comb(r["n"], i) * share**i * (1 - share) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert r["p"] == pytest.approx(want if r["k"] <= r["n"] * share else 1.0, rel=1e-9)


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside.update(range(i, i + 8))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), len(lines), sum(c.isupper() for c in text)


def test_counts_of_odd_rows(spark):
    rows = odd_rows() + [(30, "a b c d e f g h i a b c d e f g h"), (31, "Ab\nab\n\n Ab\nAb"), (32, "#a *| <b> É"), (33, "x " * 40)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).withColumn("lang", F.lit(None).cast("string"))
    got = rules.measure(df).select("doc_id", "c.*").collect()
    assert Counter(tuple(r) for r in got) == Counter((k, *plain_counts(t)) for k, t in rows)
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 1), (99, 1), (6, None), (None, 1)], "doc_id long, quality int")
    cut = rules.certify(rules.measure(df), labels)
    kept = rules.keep(df, cut)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "5", "5", "6", "None", "9", "10"])
    assert rules.keep(df.limit(0), cut).count() == 0


def test_cutoffs_need_enough_good_documents(spark):
    """A cutoff is certified with many clean labels, is not with few, and not where good documents would go."""
    text = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i}&&&" for i in range(40))
    docs = [(i, text + f" n{i}", "many") for i in range(900)] + [(1000 + i, text + f" n{i}", "few") for i in range(20)]
    docs += [(2000 + i, (noisy if i % 2 else text) + f" n{i}", "noisy") for i in range(900)] + [(5000 + i, noisy, s) for i, s in enumerate(("many", "few", "noisy"))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = df.where("doc_id < 5000").select("doc_id", F.lit(1).alias("quality"))
    cut = rules.certify(rules.measure(df), labels)
    by = {r["stratum"].split('"')[3]: r["symbols"] for r in cut.collect()}
    assert by == {"many": 20, "few": None, "noisy": None}
    kept = {r["doc_id"] for r in rules.keep(df, cut).collect()}
    assert 5000 not in kept and {5001, 5002} <= kept and len(kept) == len(docs) - 1


def test_repeated_rows_certify_nothing(spark):
    """One good document 900 times, under one key or under many, is one document of the holdout."""
    text = " ".join(f"word{i}" for i in range(40))
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id long, quality int")
    for key in ("cast(0 as long)", "id"):
        docs = spark.range(900).selectExpr(f"{key} as doc_id", f"'{text}' as text", "'en' as lang")
        cut = rules.certify(rules.measure(docs), labels).collect()
        assert [tuple(r)[1:] for r in cut] == [(None,) * len(rules.RULES)]
    twice = spark.range(1800).selectExpr("id % 900 as doc_id", f"concat('{text} n', id % 900) as text", "'en' as lang")
    once = twice.distinct()
    assert rules.certify(rules.measure(twice), labels).collect() == rules.certify(rules.measure(once), labels).collect()


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + odd_rows()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    weights = [1.0, 2.0, 1.0]
    got = sharding.shard(df, weights).collect()
    assert len(got) == len(rows)
    by_shard = Counter(r["shard"] for r in got)
    assert by_shard[1] / len(rows) == pytest.approx(0.5, abs=0.05)
    for s, n in by_shard.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard(df, [*weights, 1.0]).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    assert all(r["size"] == len((t or "").encode()) + 16 for r in got for k, t in rows[:5] if r["doc_id"] == k and k > 12)
    assert sharding.shard(df.limit(0), weights).count() == 0


def test_licences_go_down_the_tree(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    body = "\n".join(f"line {i} of a text" for i in range(200))
    files = [
        (1, "a/LICENSE", mit + "\n" + body), (2, "a/b/c/x.py", body), (3, "a/b/COPYING.txt", gpl), (4, "a/b/y.py", ""), (5, "a/z.py", None),
        (6, "a/b/c/d/h.py", "# " + mit + "\n" + body), (7, "q/x.py", body), (8, None, body), (9, None, mit), (10, "top.py", body), (2, "a/b/c/x.py", body),
        (11, "a//b/w.py", " ".join(["word"] * 30_000)), (12, "a/b2/v.py", body),
    ]
    df = with_clashes(spark.createDataFrame(files, "doc_id long, path string, text string"))
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_from"]) for r in licenses.scan(df).collect()}
    gpl_from, mit_from = ("GPL-3.0", "inherited", "a/b/COPYING.txt"), ("MIT", "inherited", "a/LICENSE")
    assert got == {
        1: ("MIT", "file", None), 2: gpl_from, 3: ("GPL-3.0", "file", None), 4: gpl_from, 5: mit_from, 6: ("MIT", "header", None),
        7: (None, "none", None), 8: (None, "none", None), 9: ("MIT", "file", None), 10: (None, "none", None), 11: gpl_from, 12: mit_from,
    }
    assert licenses.scan(df).count() == len(files) and licenses.scan(df.limit(0)).count() == 0


def test_notices_wrapped_over_lines(spark):
    notice, body = "Licensed under the Apache\nLicense, Version 2.0.\n", "\n".join(f"line {i} of a text" for i in range(200))
    files = [(1, "a/LICENSE", notice), (2, "a/b/x.py", body), (3, "q/notes.txt", notice), (4, "q/y.py", body), (5, "r/x.py", notice + body)]
    got = {r["doc_id"]: (r["license"], r["origin"], r["license_from"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None), 2: ("Apache-2.0", "inherited", "a/LICENSE"), 3: ("Apache-2.0", "file", None),
        4: ("Apache-2.0", "inherited", "q/notes.txt"), 5: (None, "none", None),
    }


def test_lines_without_anchors_are_below_the_threshold():
    model = licenses.Model()
    anchors = set(model.anchors())
    for _, v in model.vectors:
        rest = sum(x * x for w, x in v.items() if w not in anchors) ** 0.5
        assert rest < model.cosine


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against a plain version on the rows that the one before kept."""
    from collections import defaultdict

    import tiktoken
    import public_tokenizers

    from demandry.llm import bpe, pii
    from demandry.llm.queries import PSEUDONYM_KEY, rank_file
    from plain import components
    from test_copies import plain_hits

    docs = with_clashes(table(spark, sf, "documents"))
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    out = stages["quality rules"](spark, docs, sf)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    base = {k for k, t in rows.items() if (c := plain_counts(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert set(left) <= base and len(left) >= 0.9 * len(base)

    docs = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["near duplicates"](spark, docs, sf)
    groups = defaultdict(set)
    for key, _, least in components(list(left.items()), 80, 5):
        groups[least].add(key)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(left) == set(groups) and out.columns == docs.columns

    docs = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["decontamination"](spark, docs, sf)
    clean = {r[0] for r in plain_hits(list(left.items()), items) if not r[-1]}
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(left) == clean

    docs = spark.createDataFrame(out.collect(), docs.schema)
    out = stages["pseudonyms"](spark, docs, sf)
    new = {r["doc_id"]: r["text"] for r in out.collect()}
    assert new == {k: pii.rewrite(t, pii.Feistel(PSEUDONYM_KEY))[0] for k, t in left.items()}

    out = stages["tokens"](spark, spark.createDataFrame(out.collect(), docs.schema), sf)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {k: library.encode_ordinary(t) for k, t in new.items()}


def test_every_stage_takes_an_empty_table(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
