"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of PASSAGE words each, all of them encoded: shares of kinds of characters, word
lengths, repetition, and hashed pairs of bytes, then one hidden layer h. Gated attention
``a ~ exp(w . (tanh(V h) * sigmoid(U h)))`` weights the passages of a document; the weighted sum goes through one
logistic unit. Only document labels are needed: the weights of passages are learned with the rest, by Adam on the
cross entropy.

The model is fitted in one task on SAMPLE labelled documents at most, those of least key hash (a bound on rows, not
on their texts); its few thousand numbers go to the tasks that score all documents, row by row, without a shuffle.

* Null text counts as empty; an empty text is one passage without words and gets a score like any other.
* Labels that are null or have no document count for nothing; of several labels of a document, the least counts.
* Without any labels every score is 0.5; with labels of one kind only it is that kind's smoothed share.
* Repeated rows get equal scores. Only key and text are looked at, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.llm import blocks as B

PASSAGE = 64  # words
SAMPLE = 4096  # labelled documents
SPAN = 1 << 21  # bytes of text encoded at once
PAIRS = 64  # buckets for pairs of bytes
HIDDEN, GATES = 24, 12
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.01, 1e-4

_KINDS = 8
_KIND = np.zeros(256, np.uint8)  # small letters and the rest: 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[list(b"#*$%&|<>")] = 3
_KIND[list(b"!?")] = 4
_KIND[list(b".,;:'\"()-")] = 5
_KIND[list(b"{}[]\\/@^~_=+`")] = 6
_KIND[128:] = 7
N_FEATURES = _KINDS + 5 + PAIRS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each passage of each text, and how many passages each text has (one at least)."""
    words = B.split_words(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    n_words = words.last - words.first
    counts = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(counts) - counts
    passage = np.repeat(base, n_words) + (np.arange(len(words.hashes)) - np.repeat(words.first, n_words)) // PASSAGE
    total = int(counts.sum())
    inside = ~B._BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    sizes = np.flatnonzero(edge == -1) - starts
    of_byte = np.repeat(passage, sizes)  # passage of each byte of a word
    held = data[inside]
    kinds = np.bincount(of_byte * _KINDS + _KIND[held], minlength=total * _KINDS).reshape(total, _KINDS)
    chars = kinds.sum(1)
    pair = (held[:-1].astype(np.int64) * 31 + held[1:].astype(np.int64) * 17) % PAIRS
    pairs = np.bincount(of_byte[1:] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS) if len(held) > 1 else np.zeros((total, PAIRS))
    per = np.bincount(passage, minlength=total)
    h = words.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    tagged = h + passage.astype(np.uint64) * B._STEP[1]
    order = np.argsort(tagged)
    new = np.append(True, tagged[order][1:] != tagged[order][:-1])[: len(h)]
    distinct = np.bincount(passage[order][new], minlength=total)
    w, c = np.maximum(per, 1), np.maximum(chars, 1)
    square = np.bincount(passage, sizes.astype(float) ** 2, minlength=total)
    out = np.empty((total, N_FEATURES), np.float32)
    out[:, :_KINDS] = kinds / c[:, None]
    out[:, _KINDS + 0] = np.log1p(per)
    out[:, _KINDS + 1] = chars / w
    out[:, _KINDS + 2] = np.sqrt(square / w)
    out[:, _KINDS + 3] = np.bincount(passage, same, minlength=total) / w
    out[:, _KINDS + 4] = distinct / w
    out[:, _KINDS + 5 :] = np.sqrt(pairs / c[:, None])
    return out, counts


def _spans(text: bytes) -> Iterator[bytes]:
    """A very long text in parts cut at white space."""
    lo = 0
    while len(text) - lo > SPAN:
        hi = max(text.rfind(b, lo, lo + SPAN) for b in (b" ", b"\n"))
        hi = lo + SPAN if hi <= lo else hi
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def bags(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The passages of each text, in order; short texts are encoded together."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SPAN):
            size += len(texts[hi])
            hi += 1
        if hi == lo + 1:
            yield np.concatenate([features([part])[0] for part in _spans(texts[lo])])
        else:
            rows, counts = features(texts[lo:hi])
            yield from np.split(rows, np.cumsum(counts)[:-1])
        lo = hi


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters by name; forward and backward over many bags laid end to end."""

    SHAPES = {
        "W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "w": (GATES,),
        "c": (HIDDEN,), "d": (1,),
    }

    def __init__(self, parameters: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = parameters, mean, scale

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.p
        first = np.cumsum(counts) - counts
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first)
        return _sigmoid(z @ p["c"] + p["d"][0]), (x, h, v, u, a, z)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (x, h, v, u, a, z) = self.forward(x, counts)
        first = np.cumsum(counts) - counts
        g = (score - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
        dv, du = de[:, None] * p["w"] * u * (1 - v**2), de[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        out = {
            "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": ((v * u) * de[:, None]).sum(0),
            "c": z.T @ g, "d": g.sum(keepdims=True),
        }
        return {k: v + DECAY * p[k] for k, v in out.items()}

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in (*self.p.values(), self.mean, self.scale)]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "Model":
        values, at, parts = np.frombuffer(data, "<f8"), 0, []
        for shape in (*cls.SHAPES.values(), (N_FEATURES,), (N_FEATURES,)):
            n = int(np.prod(shape))
            parts.append(values[at : at + n].reshape(shape))
            at += n
        return cls(dict(zip(cls.SHAPES, parts)), parts[-2], parts[-1])


def fit_bags(found: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """Adam over shuffled batches of documents."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "WVU" else np.zeros(s) for k, s in Model.SHAPES.items()}
    p["w"] = rng.normal(0, 0.1, GATES)
    p["c"] = rng.normal(0, 0.3, HIDDEN)
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        share = (y.sum() + 1) / (len(y) + 2)
        p["c"][:] = 0
        p["d"][:] = np.log(share / (1 - share))
        return Model(p, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    rows = np.concatenate(found).astype(float)
    model = Model(p, rows.mean(0), rows.std(0) + 1e-3)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            pick = order[lo : lo + BATCH]
            bag = [found[i] for i in pick]
            g = model.gradients(np.concatenate(bag), np.array([len(x) for x in bag]), y[pick])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(key: Column) -> Column:
    """The quarter of documents that is never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> bytes:
    """The fitted model, as bytes."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"))
    known = known.where(~held_out(F.col("__key")) & F.col("__y").isNotNull() & F.col("__key").isNotNull())
    known = known.groupBy("__key").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__key"), "__key").limit(sample)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = rows.join(F.broadcast(known), "__key")  # at most ``sample`` keys are broadcast
    # One row for each key, however many the table has: that of the least text hash.
    least = F.min(F.struct(F.xxhash64("__text").alias("h"), "__text", "__y")).alias("r")
    picked = found.groupBy("__key").agg(least).select("r.__y", "r.__text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in bags([t.encode() for t in batch.column("__text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("__y"), pa.array(found, pa.binary())], ["y", "bag"])

    def learn(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table["y"].to_pylist(), table["bag"].to_pylist()))  # the same order at every run
        found = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, x in ordered]
        model = fit_bags(found, np.array([y for y, _ in ordered]))
        return pa.table({"model": pa.array([model.pack()], pa.binary())})

    encoded = picked.mapInArrow(encode, "y double, bag binary")
    got = encoded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "model binary").collect()  # one row of a few thousand numbers
    return bytes(got[0]["model"]) if got else fit_bags([], np.empty(0)).pack()


def score(docs: DataFrame, model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = rows.select(key).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model.unpack(model)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("__text").to_pylist()]
            out = np.empty(len(texts))
            held: list[np.ndarray] = []
            lo, size = 0, 0
            for i, bag in enumerate(bags(texts)):
                held.append(bag)
                size += len(bag)
                if size >= 1 << 14 or i + 1 == len(texts):
                    out[lo : i + 1] = fitted.forward(np.concatenate(held), np.array([len(x) for x in held]))[0]
                    held, lo, size = [], i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out)], [key, "score"])

    return rows.mapInArrow(run, schema)
