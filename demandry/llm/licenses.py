"""Licences of files: by their own header lines, else by the nearest directory above with a licence file.

Lines and whole files are compared with licence templates by the cosine of sparse TF-IDF vectors over lower-case
words. A line that shares none of a template's telling words cannot reach the threshold (the weight of the words that
are left bounds the cosine), so a search for those words picks the lines that are compared; nothing above the
threshold is missed. A file all of whose words together resemble a template, or that is named LICENSE, LICENCE,
COPYING or NOTICE and has such a line, is a licence file: it gives its licence to its directory. Each directory
inherits from its nearest ancestor by a join on paths, and files take it from their directory.

Only DataFrame functions. Texts are compared row by row, without a shuffle; what is joined is one row per directory,
dealt over SALTS parts so that files of one large directory meet it in many tasks.

* Null or empty text: no licence of its own. Null path: no directory, so nothing is inherited.
* Ties: the greater cosine (to nine digits), then the lesser licence name; in a directory also the lesser path.
* Repeated rows: one result each. Only key, path and text are looked at, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.llm.common import let
from demandry.session import materialize

# Short notices of widely used licences; fixed values, more may be passed.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "BSD-3-Clause": ("BSD 3-Clause License", "Redistributions in binary form must reproduce the above copyright notice."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("CC0 1.0 Universal Public Domain Dedication",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy."),
    "MPL-2.0": ("Subject to the terms of the Mozilla Public License, version 2.0.",),
}
# Common words of some languages; fixed values. They are the last to be searched for, whatever their weight.
_COMMON = set(
    "a above all an and any are as at be by copy de der des die en es est et form for free from general has in is la le les mit must of on or "
    "person que the this to un une und use with without work".split()
)
COSINE = 0.75
SALTS = 16
_NAMES = r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)(\.[^/]*)?$"


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


class Model:
    """Weights of a set of templates."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, cosine: float = COSINE):
        self.cosine = cosine
        self.texts = [(name, _words(t)) for name in sorted(templates) for t in templates[name]]
        df = Counter(w for _, ws in self.texts for w in set(ws))
        n = len(self.texts)
        self.idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in sorted(df)}
        self.unseen = math.log(n + 1) + 1
        self.vectors = []
        for name, ws in self.texts:
            v = {w: k * self.idf[w] for w, k in sorted(Counter(ws).items())}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors.append((name, {w: x / norm for w, x in v.items()}))

    def anchors(self) -> list[str]:
        """Words of which a line has one at least if it reaches the cosine: what is left of each template is too light."""
        out: set[str] = set()
        for _, v in self.vectors:
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda e: (e[0] in _COMMON, -e[1], e[0])):
                if math.sqrt(max(rest, 0)) < self.cosine - 1e-9:
                    break
                out.add(w)
                rest -= x * x
        return sorted(out)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def _counted(words: Column) -> Column:
    """(w, n) of each different word and how often it occurs: runs of the sorted words."""

    def runs(ordered: Column) -> Column:
        begins = F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), F.struct(w.alias("w"), i.alias("i"))))
        end = lambda all_, j: F.coalesce(F.get(all_, j + 1)["i"], F.size(ordered))
        return let(F.filter(begins, lambda r: r.isNotNull()), lambda rs: F.transform(rs, lambda r, j: F.struct(r["w"].alias("w"), (end(rs, j) - r["i"]).alias("n"))))

    return let(F.array_sort(words), runs)


def _dot(bag: Column, vector: Mapping[str, float]) -> Column:
    weight = F.create_map(*[F.lit(x) for w, y in vector.items() for x in (w, y)])
    return F.aggregate(bag, F.lit(0.0), lambda acc, e: acc + e["x"] * F.coalesce(F.element_at(weight, e["w"]), F.lit(0.0)))


def _best(words: Column, model: Model) -> Column:
    """(score, license) of the template nearest to a bag of words; null without words."""
    pairs = [F.lit(x) for w, i in model.idf.items() for x in (w, i)]
    idf = lambda w: F.coalesce(F.element_at(F.create_map(*pairs), w), F.lit(model.unseen))
    weighted = F.transform(_counted(words), lambda e: F.struct(e["w"].alias("w"), (e["n"] * idf(e["w"])).alias("x")))

    def scores(bag: Column) -> Column:
        norm = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda acc, e: acc + e["x"] * e["x"]))
        near = lambda some: F.array_min(F.array(*[F.struct((-F.round(_dot(some, v) / norm, 9)).alias("minus"), F.lit(name).alias("license")) for name, v in model.vectors]))
        shared = F.filter(bag, lambda e: F.array_contains(F.array(*[F.lit(w) for w in model.idf]), e["w"]))
        return F.when(F.size(bag) > 0, let(shared, near))

    return let(weighted, scores)


def own(files: DataFrame, *, key: str = "doc_id", path: str = "path", text: str = "text", model: Model | None = None) -> DataFrame:
    """key, path, own (score, license of the best line, else of the whole file if that matches, or null) and whole (of the
    whole file, if a line holds an anchor)."""
    model = model or Model()
    some = r"(?i)(^|[^a-z0-9])(" + "|".join(model.anchors()) + r")($|[^a-z0-9])"
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.when(body.rlike(some), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(some))).otherwise(F.array().cast("array<string>"))
    near = lambda x: F.filter(F.transform(F.array_distinct(x), lambda line: _best(tokens(line), model)), lambda b: -b["minus"] >= F.lit(model.cosine))
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), let(lines, lambda x: F.array_min(near(x))).alias("own"), F.when(body.rlike(some), body).alias("__text"))
    # A file that resembles a template as a whole holds an anchor; its lines need not resemble one.
    rows = rows.withColumn("whole", F.when(F.col("__text").isNotNull(), _best(tokens(F.col("__text")), model))).drop("__text")
    return rows.withColumn("own", F.coalesce("own", F.when(-F.col("whole.minus") >= F.lit(model.cosine), F.col("whole"))))


def directory(path: Column) -> Column:
    """All of a path before its last part; empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/+$", "")


def above(place: Column) -> Column:
    """A directory and all above it, as (depth, name); the top has depth 0 and no name."""
    parts = F.filter(F.split(place, "/", -1), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name")))


def scan(files: DataFrame, *, key: str = "doc_id", path: str = "path", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per file: key, path, license, score (of its own line), origin (file, header, inherited, none) and license_from."""
    model = model or Model()
    # Used three times below, and narrow: written once.
    rows = materialize(own(files, key=key, path=path, text=text, model=model), "licenses")
    is_file = F.col("own").isNotNull() & ((-F.col("whole.minus") >= F.lit(model.cosine)) | F.coalesce(F.col("path").rlike(_NAMES), F.lit(False)))
    rows = rows.withColumn("is_file", is_file).withColumn("place", F.array_join(F.filter(F.split(directory(F.col("path")), "/", -1), lambda p: p != ""), "/"))
    given = rows.where("is_file").where(F.col("place").isNotNull()).groupBy("place").agg(F.min(F.struct("own.minus", "own.license", "path")).alias("given"))
    places = rows.where(F.col("place").isNotNull()).groupBy("place").agg(F.count("*").alias("n"))
    up = places.select(F.col("place").alias("at"), F.explode(above(F.col("place"))).alias("up"))
    nearest = (
        up.join(given, F.col("up.name") == F.col("place"))
        .groupBy("at")
        .agg(F.max_by(F.struct("given.license", F.col("given.path").alias("license_from")), F.col("up.depth")).alias("near"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(nearest, (F.col("place") == F.col("at")) & (F.col("__salt") == F.col("salt")), "left")
    mine = F.col("own").isNotNull()
    return joined.select(
        F.col("key").alias(key),
        F.col("path").alias(path),
        F.when(mine, F.col("own.license")).otherwise(F.col("near.license")).alias("license"),
        F.when(mine, F.round(-F.col("own.minus"), 6)).alias("score"),
        F.when(F.col("is_file"), "file").when(mine, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near.license_from")).alias("license_from"),
    )
