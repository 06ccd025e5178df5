"""Quality rules whose cutoffs are chosen under a guarantee on labelled documents.

Every rule compares two counts of a document, ``100 * part >= cutoff * whole``, and has a short list of cutoffs
fixed beforehand, from lenient to strict. Labelled good documents are the holdout. For each stratum and cutoff
they give the number k of n good documents that the cutoff would reject, and the exact binomial tail
``P(Bin(n, a) <= k)`` is the p-value of "it rejects more than a share a of the good". A cutoff is certified
where that p-value is at most ``delta / (strata * rules)`` (Bonferroni over strata and rules; along one list k only
grows, so testing from lenient to strict needs no more correction), with ``a = alpha / rules``, so that all rules of
a stratum together reject more than ``alpha`` of its good documents with probability ``delta`` at most over all
strata. The strictest certified cutoff of each rule is used; a stratum with too few labels gets none and its
documents are kept.

Only DataFrame functions: counts are worked out row by row, without a shuffle; the holdout is a join of
labels with the narrow table of counts.

* Null text counts as empty. Null stratum values form a stratum of their own.
* Empty text: all counts 0, so no rule compares true and the base rules (below 20 words) reject it.
* Labels without a document, and null labels, count for nothing; repeated labels count once.
* Repeated rows are judged each by itself. Other columns are carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.llm.common import SPACE, let, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Reject where ``100 * part >= cutoff * whole``; cutoffs from lenient to strict."""

    part: str
    whole: str
    cutoffs: tuple[int, ...]


RULES: Mapping[str, Rule] = {
    "symbols": Rule("n_symbols", "n_words", (200, 100, 50, 30, 20)),
    "capitals": Rule("n_upper", "word_chars", (80, 60, 50, 40, 30)),
    "repeats": Rule("n_repeat_words", "n_words", (30, 25, 20)),
    "same_lines": Rule("n_dup_lines", "n_lines", (90, 70, 50)),
    "long_words": Rule("word_chars", "n_words", (3000, 2000, 1500)),
}
ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# Strata beyond this many meet their documents in a shuffled join instead of a broadcast one.
BROADCAST_STRATA = 10_000


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``hashes`` are those of all windows in order."""
    at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(pairs: Column) -> Column:
        same = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        return F.filter(pairs, lambda p, j: same(p, j - 1) | same(p, j + 1))

    starts = F.array_sort(F.transform(let(at, twice), lambda p: p["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n"), (s + WINDOW).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeated_words(word_list: Column) -> Column:
    """Words of a list that lie in 8-word windows found twice or more in it, the first included.

    Windows are compared by 64-bit hash inside one document."""

    def windows(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(each, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))
    return let(let(F.transform(word_list, lambda w: F.xxhash64(w)), windows), count)


def counts(text: Column) -> Column:
    """All counts of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def all_of(both: Column) -> Column:
        values = {
            "n_words": both["w"]["n"],
            "word_chars": without(SPACE),
            "n_symbols": F.length(text) - without("[#*$%&|<>]+"),
            "n_dup_lines": both["l"]["dup"],
            "n_repeat_words": both["w"]["repeat"],
            "n_lines": both["l"]["n"],
            "n_upper": F.length(text) - without(r"\p{Lu}+"),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), all_of)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def _hit(c: Column, rule: Rule, cutoff: Column) -> Column:
    """Whether the rule rejects; never where there is no cutoff or nothing to compare with."""
    return F.coalesce((c[rule.whole] > 0) & (100 * c[rule.part] >= cutoff * c[rule.whole]), F.lit(False))


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(Bin(n, share) <= k), by the ratio of one term to the next; 1 where k is above the mean."""
    step = F.lit(math.log(share / (1 - share)))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + step
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    first = n.cast("double") * F.lit(math.log1p(-share))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    tail = F.when(k < 1, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, add, lambda a: a["sum"]))
    return F.when(k > n * F.lit(share), F.lit(1.0)).otherwise(tail)


def certify(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "stratum", label: str = "quality",
            rules: Mapping[str, Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with good labelled documents: the certified cutoff of each rule, or null.

    ``measured`` has key, stratum, ``c``, the struct of counts, and ``text_md5``. The bound holds for independent documents, so each
    key counts once (by the text of least digest), and each text once in a stratum."""
    good = labels.where(F.col(label) == 1).select(key).distinct()
    held = measured.where(~base_failed(F.col("c"))).join(good, key, "left_semi")
    by_key = held.groupBy(key).agg(F.min(F.struct("text_md5", stratum, "c")).alias("r")).select("r.*")
    held = by_key.groupBy(stratum, "text_md5").agg(F.min("c").alias("c"))
    tests = [(name, i) for name, r in rules.items() for i in range(len(r.cutoffs))]
    rejected = [
        F.count_if(_hit(F.col("c"), rules[name], F.lit(rules[name].cutoffs[i]))).alias(f"{name}_{i}") for name, i in tests
    ]
    by_stratum = held.groupBy(stratum).agg(F.count("*").alias("n"), *rejected)
    # One row per stratum, so few that the count of strata may be a plain aggregate beside it.
    level = by_stratum.agg((F.lit(delta) / (F.greatest(F.count("*"), F.lit(1)) * len(rules))).alias("level"))
    tested = by_stratum.join(F.broadcast(level))  # one row

    def chosen(name: str, rule: Rule) -> Column:
        passed = lambda i: binomial_tail(F.col(f"{name}_{i}"), F.col("n"), alpha / len(rules)) <= F.col("level")
        strict_first = range(len(rule.cutoffs) - 1, -1, -1)
        return F.coalesce(*[F.when(passed(i), F.lit(rule.cutoffs[i])) for i in strict_first]).alias(name)

    return tested.select(stratum, *[chosen(name, r) for name, r in rules.items()])


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: Sequence[str] = ("lang",)) -> DataFrame:
    """key, stratum, counts ``c`` and text_md5; nothing else, so no other column name can clash."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.select(F.col(key), _stratum(stratum).alias("stratum"), counts(F.col(text)).alias("c"), digest.alias("text_md5"))


def _stratum(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(columns)]))


def judge(measured: DataFrame, cutoffs: DataFrame, rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """``measured`` with base_failed and kept. ``cutoffs``: as certify() returns them."""
    cut = cutoffs.select("stratum", F.struct(*rules).alias("__cut"))
    few = cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = measured.join(F.broadcast(cut) if few else cut, "stratum", "left")
    c = F.col("c")
    hits = [_hit(c, r, F.col("__cut")[name]) for name, r in rules.items()]
    out = joined.withColumn("base_failed", base_failed(c))
    rejected = hits[0]
    for h in hits[1:]:
        rejected = rejected | h
    return out.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("__cut")


def keep(docs: DataFrame, cutoffs: DataFrame, *, text: str = "text", stratum: Sequence[str] = ("lang",)) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; each row is judged by itself, without a shuffle."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    # As a generator's columns the counts are worked out once a row; a filter would otherwise be moved below them
    # and write them out again at each of its parts.
    rows = docs.select(held, _stratum(stratum).alias("stratum"), F.inline(F.array(counts(F.col(text)))))
    names = [c for c in rows.columns if c not in ("__row", "stratum")]
    judged = judge(rows.select("__row", "stratum", F.struct(*names).alias("c")), cutoffs)
    return judged.where("kept").select("__row.*")
