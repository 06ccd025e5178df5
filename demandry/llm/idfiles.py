"""Token ids in binary files: one zstandard frame a document, all with one trained dictionary.

``write`` encodes texts with a tokenizer file, appends an end id to each, and writes the ids in order of the keys. A
file is a header (magic, bytes an id, SHA-256 of the dictionary) and then one frame after another, each of which can be
read by itself; a file ends once it holds ``FILE_BYTES``. The index is a Parquet table with a row for each document:
file, offset and size of its frame, ids in it and ids before it. ``read`` opens the files of an index, or of some rows of
it (``lookup``), and decompresses single frames; a file that was written with another dictionary is refused.

Texts are shuffled once, into ranges of (key, text hash, row), so rows of one key and even equal rows are dealt over
many tasks. Frames are never shuffled: a task writes its range and returns index rows. A task that runs again
writes files of new names, and the index names the files of the run that counted; what a lost run left is not read.
A task holds one batch of texts and the ids of one document.

The dictionary is trained on passages of ``SAMPLE`` rows of least hash, ``PASSAGE`` code points each: at most 4 MB. This decides
about the size of the files alone. Where that is too little to train on, the passages themselves are the dictionary.

Files lie where ``pyarrow.fs`` can reach them by the folder's URI (local and mounted folders, HDFS, S3, GCS).

* null text: empty, so only the end id. Null keys come first. An empty table: an index without rows, no files.
* Rows of equal keys are in the order of their text hash; equal rows each have a frame.
* Other columns are not looked at. Special tokens are found in texts as the library finds them.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

MAGIC = b"IDFRAME1"
HEADER = struct.Struct("<8sB32s")
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20  # the part of a file that one reader's row group covers
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
SAMPLE, PASSAGE = 2048, 2048
SPAN = 1 << 22  # code points that are cut into words at once
KNOWN, KNOWN_WORD = 1_500_000, 64  # words whose ids a worker remembers (some 150 bytes each), and the longest of them
TOGETHER = 2000  # new words that are encoded in one call

# A blank between two signs that are not white space always begins a new piece of the byte-level pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c != " "]
# Latin letters and then ASCII signs: two pieces of the byte-level pattern at most. An apostrophe may begin an ending such as 's, so
# it is left out.
_LATIN, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"([{_LATIN}]+)({_SIGNS})")
_INSIDE_PLAIN = re.compile(f"[{_LATIN}]*{_SIGNS}")
# The byte-level alphabet's signs for bytes that do not stand for themselves.
_ALPHABET = {x: 256 + n for n, x in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_BLANK = chr(_ALPHABET[0x20])


class Encoder:
    """Ids of texts as bytes of little-endian numbers, by the tokenizers library.

    A byte-level tokenizer's ids of a text are those of its words: each worker encodes a word once. Plain words (Latin
    letters, then signs) go straight to the tokenizer's model, piece by piece. Other tokenizers are given whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        self.by_word = (
            self.tokenizer.normalizer is None
            and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
            and not self.tokenizer.pre_tokenizer.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added.values())
        )
        # An added token inside a plain word would be found before the pieces are.
        self.plain = self.by_word and self.tokenizer.pre_tokenizer.use_regex and not any(_INSIDE_PLAIN.fullmatch(t.content) for t in added.values())
        # A byte-level token has one sign for each of its bytes.
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_plain(self, words: list[str], out: dict[str, bytes]) -> list[str]:
        """Plain words' ids into ``out``; returns the other words."""
        pieces, pack = self.tokenizer.model.tokenize, {2: "H", 4: "I"}[self.dtype.itemsize]
        tails: dict[str, list[int]] = {"": []}
        others = []
        for w in words:
            found = _PLAIN.fullmatch(w)
            if found is None:
                others.append(w)
                continue
            letters, tail = found.groups()
            if tail not in tails:
                tails[tail] = [t.id for t in pieces(tail)]
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_ALPHABET)
            ids = [t.id for t in pieces(_BLANK + letters)] + tails[tail]
            out[w] = struct.pack(f"<{len(ids)}{pack}", *ids)
        return others

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a blank before it."""
        out = {}
        # Long words, and the ends of texts, whose white space would join the next word's blank.
        alone = [w for w in words if not w or len(w) > KNOWN_WORD or w[-1].isspace()]
        out.update(zip(alone, self._whole([" " + w for w in alone])))
        words = [w for w in words if w not in out]
        if self.plain:
            words = self._learn_plain(words, out)
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            raw = self._whole([" " + " ".join(some)])[0]
            reach = np.cumsum(self.n_bytes[np.frombuffer(raw, self.dtype)])
            ends = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in some])
            cut = np.searchsorted(reach, ends)
            if len(reach) != cut[-1] + 1 or not np.array_equal(reach[cut], ends):
                raise ValueError("a token reaches over the border of two words")
            places = [0, *((cut + 1) * self.dtype.itemsize).tolist()]
            out.update((w, raw[a:b]) for w, a, b in zip(some, places, places[1:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        out = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        starts: list[tuple[int, str]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if len(self.known) > KNOWN:
                self.known.clear()
            # Each word is looked up once; the places of new ones are filled in afterwards.
            found = [list(map(self.known.get, words)) for _, words in held]
            gaps = [[k for k, x in enumerate(got) if x is None] if None in got else [] for got in found]
            ids = self._learn(list({words[k] for (_, words), missing in zip(held, gaps) for k in missing}))
            self.known.update(ids)
            firsts = self._whole([first for _, first in starts])
            for (i, _), x in zip(starts, firsts):
                out[i].append(x)
            for (i, words), got, missing in zip(held, found, gaps):
                for k in missing:
                    got[k] = ids[words[k]]
                out[i].append(b"".join(got))
            for w in ids:
                if len(w) > KNOWN_WORD:
                    del self.known[w]
            held.clear()
            starts.clear()
            size = 0

        for i, text in enumerate(texts):
            for at, span in spans(text):
                words = _CUT.split(span) if crowded(span) else span.split(" ")
                if at == 0:
                    starts.append((i, words[0]))
                    del words[0]
                held.append((i, words))
                size += len(span)
                if size >= SPAN:
                    settle()
        settle()
        return [b"".join(parts) for parts in out]


def crowded(text: str) -> bool:
    """Whether a blank stands beside white space."""
    return "  " in text or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _WHITE)


def spans(text: str) -> Iterator[tuple[int, str]]:
    """A text in spans of some ``SPAN`` code points, cut at blanks between words; the blanks are left out."""
    at = 0
    while len(text) - at > SPAN:
        cut = _CUT.search(text, at + SPAN)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.end()
    yield at, text[at:] if at else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary trained on ids of at most ``SAMPLE`` passages; it does not depend on the order of the rows."""
    h = F.xxhash64(F.col(key), F.col(text))
    start = F.pmod(h, F.greatest(F.length(text) - F.lit(PASSAGE), F.lit(1))).cast("int") + 1
    rows = docs.where(F.length(text) > 0).select(h.alias("h"), F.substring(F.col(text), start, F.lit(PASSAGE)).alias("passage"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        samples = [x for b in batches for x in encode(b.column(0).to_pylist())]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples
            data = b"".join(samples)[:DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["dictionary"])

    sample = rows.orderBy("h", "passage").limit(SAMPLE).select("passage").coalesce(1)
    found = sample.mapInArrow(learn, "dictionary binary").first()
    return bytes(found["dictionary"]) if found else b""


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


class _Writer:
    """Files of one task: frames one after another, a new file once one is full."""

    def __init__(self, folder: str, shard: int, width: int, dictionary: bytes):
        self.fs, self.folder = _place(folder)
        self.stem = f"{shard:06d}-{uuid.uuid4().hex}"
        self.header = HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest())
        self.files, self.out, self.offset, self.name = 0, None, 0, ""

    def add(self, frame: bytes) -> tuple[str, int]:
        """File and offset of a frame."""
        if self.out is None or self.offset >= FILE_BYTES:
            self.close()
            self.name = f"{self.stem}-{self.files:05d}.ids"
            self.out, self.files = self.fs.open_output_stream(f"{self.folder}/{self.name}"), self.files + 1
            self.out.write(self.header)
            self.offset = len(self.header)
        at, self.offset = self.offset, self.offset + len(frame)
        self.out.write(frame)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


INDEX = ["key", "shard", "file", "offset", "size", "n_tokens", "before"]


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", dictionary: bytes | None = None
) -> DataFrame:
    """Write the files into ``folder`` (new or empty) and return the index, which is written there as well."""
    spark = docs.sparkSession
    shared = train(docs, tokenizer, key, text) if dictionary is None else dictionary
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("row")]
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("shard"))
    _, local = _place(folder)
    _place(folder)[0].create_dir(f"{local}/data", recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        end = np.array([end_id], ids.dtype).tobytes()
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared), write_checksum=True)
        writer, before = None, 0
        for batch in batches:
            found = []
            for raw in ids.encode(batch.column("text").to_pylist()):
                if writer is None:
                    writer = _Writer(f"{folder}/data", batch.column("shard")[0].as_py(), ids.dtype.itemsize, shared)
                n = len(raw) // ids.dtype.itemsize + 1
                frame = frames.compress(raw + end)
                found.append((*writer.add(frame), len(frame), n, before))
                before += n
            file, offset, size, n_tokens, at = zip(*found) if found else ((),) * 5
            longs = [pa.array(x, pa.int64()) for x in (offset, size, n_tokens, at)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("shard"), pa.array(file, pa.string()), *longs], INDEX)
        if writer is not None:
            writer.close()

    longs = [StructField(c, LongType()) for c in INDEX[3:]]
    schema = StructType([StructField("key", rows.schema["key"].dataType), ranged.schema["shard"], StructField("file", StringType()), *longs])
    ranged.mapInArrow(store, schema).write.parquet(f"{folder}/index")
    spark.createDataFrame([(hashlib.sha256(shared).hexdigest(), bytearray(shared))], "sha256 string, dictionary binary").write.parquet(f"{folder}/dictionary")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """key, file, offset, size, n_tokens and start (ids of all documents before) of each document."""
    rows = spark.read.parquet(f"{folder}/index")
    # One row for each writing task.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    return rows.join(starts, "shard").select("key", "file", "offset", "size", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def _checked(file: pa.NativeFile, digest: bytes) -> np.dtype:
    """The type of the ids in a file, which must have been written with the dictionary of this digest."""
    magic, width, of = HEADER.unpack(file.read_at(HEADER.size, 0))
    if magic != MAGIC or of != digest:
        raise ValueError("no file of ids with this dictionary")
    return np.dtype(f"<u{width}")


def _frames(rows: DataFrame, folder: str, make: Callable[[list[np.ndarray]], list], out: StructField) -> DataFrame:
    """The index rows with a column made of their ids, which are read from the files."""
    spark = rows.sparkSession
    kept = spark.read.parquet(f"{folder}/dictionary").first()  # at most DICTIONARY_BYTES
    shared = bytes(kept["dictionary"])
    digest = hashlib.sha256(shared).digest()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(tasks, "file", F.floor(F.col("offset") / F.lit(READ_BYTES))).sortWithinPartitions("file", "offset")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = _place(f"{folder}/data")
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(shared))
        name, file, dtype = None, None, None
        for batch in batches:
            made = []
            for f, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{local}/{f}")
                    dtype = _checked(file, digest)
                made += make([np.frombuffer(expand.decompress(file.read_at(size, offset)), dtype)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, out.name])
        if file is not None:
            file.close()

    kind = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[out.dataType.simpleString()]
    return near.mapInArrow(get, StructType([*near.schema.fields, out]))


def read(rows: DataFrame, folder: str) -> DataFrame:
    """Index rows with ``ids``, the end id included."""
    return _frames(rows, folder, lambda found: [x.astype(np.int64) for x in found], StructType.fromDDL("ids array<bigint>")["ids"])


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """key, start, n_tokens and ids of the documents named in ``keys`` (column ``key``); only their frames are read."""
    found = index(spark, folder).join(keys.select("key").distinct(), "key", "left_semi")
    return read(found, folder).select("key", "start", "n_tokens", "ids")


def checksums(rows: DataFrame, folder: str) -> DataFrame:
    """Index rows with ``ids_crc32`` of the ids as little-endian numbers of 32 bits, as they are read from the files."""
    return _frames(rows, folder, lambda found: [zlib.crc32(x.astype("<u4").tobytes()) for x in found], StructField("ids_crc32", LongType()))
