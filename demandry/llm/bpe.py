"""Byte-level BPE by a given rank file: encoding, decoding, and offsets of the tokens.

A text is cut into pieces without a regex. Its code points become an array of classes (letter, number, blank,
other white space, apostrophe, ...); each class is a transition function over ten states, and functions are
composed, which is associative: blocks of code points are composed side by side, the block functions are
scanned, and a second pass gives the state at every code point. States and classes then say where pieces
begin. Each piece is merged by rank once per task and kept in a bounded cache.

Rows are handled one by one in Arrow batches; nothing is shuffled, and a batch's memory is that of its texts.
A very long text is scanned in spans, the state carried over.

* Null text counts as empty: no tokens, empty bytes.
* Ties: of equal ranks, the leftmost pair merges first. Repeated rows: one result each. Empty table: no rows.
* Other columns are carried along as they are by ``encode`` and ``decode``; ``digests`` looks at key and text only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandry.llm.common import kind

# Classes of code points. Small letters that can end an apostrophe's piece have classes of their own.
LETTER, ONE, R, V, L, E, NUMBER, BLANK, WHITE, QUOTE, SIGN, BETWEEN = range(12)
_LETTERS = (LETTER, ONE, R, V, L, E)
_SMALL = {"s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": L, "e": E}
# Code points that count as white space besides the blank: the Unicode property, a fixed list.
_WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# States, by what came last: letters, numbers, signs, a blank, other white space (also: nothing yet), an
# apostrophe that begins a piece, that with r, v or l, and a whole ending such as 've.
IN_LETTERS, IN_NUMBERS, IN_SIGNS, AT_BLANK, AT_WHITE, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ENDED = range(10)
_STATES = 10
_PENDING = (QUOTE_R, QUOTE_V, QUOTE_L)
_OUTSIDE = sys.maxunicode + 1  # stands between two texts
_SPAN = 1 << 18  # code points scanned at once
_BLOCK = 64
_CACHE = 150_000  # pieces kept per worker in each of two generations
_CACHED_LENGTH = 64  # longer pieces are merged each time, so that what a worker keeps is bounded
_LONG_PIECE = 256  # bytes from which a heap finds the next pair


def _next(of: int, state: int) -> int:
    if of in _LETTERS:
        if state == AT_QUOTE:
            return {ONE: ENDED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(of, IN_LETTERS)
        whole = (state in (QUOTE_R, QUOTE_V) and of == E) or (state == QUOTE_L and of == L)
        return ENDED if whole else IN_LETTERS
    if of == QUOTE:
        return IN_SIGNS if state in (IN_SIGNS, AT_BLANK, AT_QUOTE) else AT_QUOTE
    return {NUMBER: IN_NUMBERS, BLANK: AT_BLANK, SIGN: IN_SIGNS}.get(of, AT_WHITE)


def _begins(of: int, before: int, after: int) -> bool:
    """Whether a code point begins a piece, as far as the states say; see piece_starts for the rest."""
    if of in _LETTERS:
        joins = (IN_LETTERS, AT_BLANK, *_PENDING)
        return before not in joins and not (before == AT_QUOTE and after == ENDED)
    if of == NUMBER:
        return before not in (IN_NUMBERS, AT_BLANK)
    if of in (BLANK, WHITE):
        return before not in (AT_BLANK, AT_WHITE)
    return before not in (IN_SIGNS, AT_BLANK, AT_QUOTE)


class Transitions:
    """The transition functions of all classes, closed under composition.

    There are few different compositions, so each has a number and composing is a look-up."""

    def __init__(self) -> None:
        functions = [tuple(range(_STATES))]
        number = {functions[0]: 0}

        def numbered(f: tuple[int, ...]) -> int:
            if f not in number:
                number[f] = len(functions)
                functions.append(f)
            return number[f]

        self.of_class = np.array([numbered(tuple(_next(k, s) for s in range(_STATES))) for k in range(BETWEEN + 1)], np.intp)
        known = 0
        while known < len(functions):  # composing with every class reaches every composition
            known = len(functions)
            for f in list(functions):
                for g in self.of_class:
                    numbered(tuple(functions[g][x] for x in f))
        n = self.size = len(functions)
        table = np.array(functions, np.intp)
        ids = {f: i for i, f in enumerate(functions)}
        self.then = np.array([ids[tuple(table[g][table[f]])] for f in range(n) for g in range(n)], np.intp)
        self.apply = table.reshape(-1)
        cases = [(k, b, a) for k in range(BETWEEN + 1) for b in range(_STATES) for a in range(_STATES)]
        self.begins = np.array([_begins(*c) for c in cases])

    def states(self, classes: np.ndarray, start: int) -> np.ndarray:
        """State after each code point: block functions composed side by side, then scanned, then applied."""
        n, blocks = len(classes), -(-len(classes) // _BLOCK)
        held = np.zeros(blocks * _BLOCK, np.intp)
        held[:n] = self.of_class[classes]
        columns = np.ascontiguousarray(held.reshape(blocks, _BLOCK).T)
        whole = columns[0]
        for column in columns[1:]:
            whole = self.then[whole * self.size + column]
        reach = 1
        while reach < blocks:  # an inclusive scan by doubling
            whole = np.concatenate([whole[:reach], self.then[whole[:-reach] * self.size + whole[reach:]]])
            reach *= 2
        state = np.empty(blocks, np.intp)
        state[0] = start
        state[1:] = self.apply[whole[:-1] * _STATES + start]
        out = np.empty((blocks, _BLOCK), np.uint8)
        for i, column in enumerate(columns):
            state = self.apply[column * _STATES + state]
            out[:, i] = state
        return out.reshape(-1)[:n]


def class_table() -> np.ndarray:
    """Class of every code point, from the general categories, and of the mark between texts."""
    groups = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((groups.get(unicodedata.category(chr(i))[0], SIGN) for i in range(sys.maxunicode + 1)), np.uint8)
    out = np.append(out, np.uint8(BETWEEN))
    out[_WHITE] = WHITE
    out[ord(" ")] = BLANK
    out[ord("'")] = QUOTE
    for letter, k in _SMALL.items():
        out[ord(letter)] = k
    return out


def piece_starts(points: np.ndarray, table: np.ndarray, moves: Transitions, span: int = _SPAN) -> np.ndarray:
    """Whether a piece begins at each code point; texts are kept apart by ``_OUTSIDE``, which begins none."""
    n = len(points)
    classes = table[points]
    states = np.empty(n + 1, np.uint8)
    states[0] = AT_WHITE
    for lo in range(0, n, span):
        states[lo + 1 : min(n, lo + span) + 1] = moves.states(classes[lo : lo + span], int(states[lo]))
    before, after = states[:-1], states[1:]
    start = moves.begins[(classes.astype(np.int32) * _STATES + before) * _STATES + after]
    # r, v or l after an apostrophe begin a piece unless the next letter makes the ending whole.
    pending = np.flatnonzero((after >= QUOTE_R) & (after <= QUOTE_L))
    whole = np.append(after, AT_WHITE)[pending + 1] == ENDED
    start[pending] = ~whole
    # A run of white space before other text gives up its last code point: a piece, or the blank that leads one.
    white = (classes == BLANK) | (classes == WHITE)
    other = ~white & (classes != BETWEEN)
    start[:-1] |= white[:-1] & other[1:]
    # The first code point of a text.
    outside = classes == BETWEEN
    start[1:] |= outside[:-1]
    start[:1] = True
    start[outside] = False
    return start


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of one piece: the pair of least rank, leftmost first, merges until none has a rank."""
    if piece in ranks:
        return [piece]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > _LONG_PIECE:
        return _merge_long(parts, ranks)
    none = len(ranks)
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """The same for long pieces, in n log n: a heap of (rank, place) over a linked list."""
    n = len(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or len(parts[i]) != a or len(parts[j]) != b:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
    return [p for p, on in zip(parts, alive) if on]


class Codec:
    """Encoder and decoder of one rank file; built once per task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.table = class_table()
        self.moves = Transitions()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple([self.ranks[t] for t in merge(piece.encode(), self.ranks)])
        if len(piece) > _CACHED_LENGTH:
            return ids
        if len(self.cache) >= _CACHE:  # what is still in use comes back from the older generation
            self.older, self.cache = self.cache, {}
        self.cache[piece] = ids
        return ids

    def pieces(self, texts: list[str]) -> Iterator[list[str]]:
        """Pieces of each text; the texts are scanned as one array."""
        gap = np.array([_OUTSIDE], np.uint32)
        arrays = [a for t in texts for a in (np.frombuffer(t.encode("utf-32-le"), np.uint32), gap)]
        points = np.concatenate(arrays) if arrays else gap
        starts = np.flatnonzero(piece_starts(points, self.table, self.moves))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(starts, ends)
        lo, begin = 0, 0
        for t, hi, end in zip(texts, cuts.tolist(), ends.tolist()):
            at = (starts[lo:hi] - begin).tolist()
            yield list(map(t.__getitem__, map(slice, at, [*at[1:], None]))) if at else []
            lo, begin = hi, end

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text, in order; short texts are scanned together."""
        make = self._ids
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) < _SPAN:
                size += len(texts[hi])
                hi += 1
            for found in self.pieces(texts[lo:hi]):
                get = self.cache.get  # pieces made meanwhile may go to a new generation; ids stay right
                yield list(chain.from_iterable([get(p) or make(p) for p in found]))
            lo = hi

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte position in the text at which each token begins."""
        lengths = np.fromiter(map(len, map(self.bytes_of.__getitem__, ids)), np.int64, len(ids))
        return (np.cumsum(lengths) - lengths).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file that is installed on every machine, once per worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(read_ranks(path))
    return _CODECS[path]


def _plain(df: DataFrame, new: set[str]) -> list[str]:
    """Columns carried along: an earlier column of a name that is written now gives way."""
    return [c for c in df.columns if c not in new]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """``docs`` with token ids and the byte offset of each token; columns of those names are replaced."""
    held = _plain(docs, {ids, offsets} - {text})
    rows = docs.select(*[F.col(f"`{c}`") for c in held])
    schema = StructType([*rows.schema.fields]).add(ids, kind("array<int>")).add(offsets, kind("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = list(c.encode_all([t or "" for t in part.column(text).to_pylist()]))
                more = [pa.array(found, pa.list_(pa.int32())), pa.array([c.offsets(x) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*held, ids, offsets])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids; null ids count as none."""
    held = _plain(df, {out} - {ids})
    rows = df.select(*[F.col(f"`{c}`") for c in held])
    schema = StructType([*rows.schema.fields]).add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = pa.array([c.decode(x or []) for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*held, out])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: a round trip of each text, of which only digests are kept."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = rows.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        number = list(map(str, range(len(c.bytes_of))))
        for batch in batches:
            counts, ids_hex, back_hex = [], [], []
            for ids in c.encode_all([t or "" for t in batch.column("__text").to_pylist()]):
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest())
                back_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            columns = [batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(back_hex)]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema)
