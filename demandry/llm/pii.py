"""Format-preserving pseudonyms for personal data.

Values that pass their check (a card number its check digit, an address its ranges, a date the calendar) are numbers
of a finite format: so many digits, so many letters, so many days. A keyed Feistel network permutes the numbers
below the size of the format, walking on while a result falls outside, so a pseudonym has the same format, passes
the same check, and equal values get equal pseudonyms in every document. With the key, ``reveal`` undoes it.

Texts are handled row by row in Arrow batches, without a shuffle.

Cards and IBANs are searched for among all numbers that the groups of a run of digits or capitals allow, not only in
the longest one, so a number beside them hides none. Where a pseudonym would make such a neighbour pass its check and
be found in its stead, the walk goes on until it does not, so that ``reveal`` finds the same places; only there may a
value have another pseudonym than elsewhere.

A secret holds the signs of base64 and of tokens, whatever its length. Strings of more than 128 signs are permuted by chunks; two
that begin alike are then linked by their beginnings as well. Phones without a country code are ten digits in the layouts
``(212) 555-0134`` and ``212-555-0134``; they are numbers of their own, not linked with those that have a code.

* Null text stays null, empty text stays empty; neither has findings. Repeated rows: one result each.
* Of overlapping findings, the one that begins first is replaced; of two at one place, the kind named first in KINDS,
  then an IBAN of its country's length, then the longer one.
* All other columns are carried along as they are.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandry.llm.common import kind

ROUNDS = 10
_CHUNK = 128  # longer strings are permuted by chunks of so many signs
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Feistel:
    """A keyed permutation of 0 .. size-1 for every size, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, size: int, i: int, half: int) -> int:
        said = f"{tweak}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest())

    def _pass(self, x: int, size: int, tweak: str, back: bool) -> int:
        a = _root(size)  # numbers are pairs (l, r) with l below a and r below b, a * b >= size
        b = -(-size // a)
        sides = (a, b)
        pair = list(divmod(x, b))
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            side = i % 2
            change = self._round(tweak, size, i, pair[1 - side])
            pair[side] = (pair[side] + (-change if back else change)) % sides[side]
        return pair[0] * b + pair[1]

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        x = self._pass(x, size, tweak, back)
        while x >= size:  # a * b is little above the size: few steps
            x = self._pass(x, size, tweak, back)
        return x


def _root(n: int) -> int:
    x = 1 << ((n.bit_length() + 1) // 2)
    while x * x > n:
        x = (x + n // x) // 2
    return max(x, 1)


def _by_position(value: str, alphabets: list[str], tweak: str, f: Feistel, back: bool) -> str:
    """Permute a string among all with the same alphabet at each position; a long one by chunks, each under the clear ones before it."""
    out, said = [], b""
    for lo in range(0, len(value), _CHUNK):
        part = value[lo : lo + _CHUNK]
        new = _chunk(part, alphabets[lo : lo + _CHUNK], f"{tweak}|{said.hex()}" if lo else tweak, f, back)
        said = hashlib.blake2b(said + (new if back else part).encode(), digest_size=16).digest()
        out.append(new)
    return "".join(out)


def _chunk(value: str, alphabets: list[str], tweak: str, f: Feistel, back: bool) -> str:
    size, x = 1, 0
    for c, alphabet in zip(value, alphabets):
        size, x = size * len(alphabet), x * len(alphabet) + alphabet.index(c)
    x, out = f.permute(x, size, tweak, back), []
    for alphabet in reversed(alphabets):
        x, i = divmod(x, len(alphabet))
        out.append(alphabet[i])
    return "".join(reversed(out))


def _kept_layout(value: str, new: str) -> str:
    """The letters and digits of ``new`` in the layout of ``value``."""
    rest = iter(new)
    return "".join(next(rest) if c.isalnum() else c for c in value)


def _digits(value: str, tweak: str, f: Feistel, back: bool) -> str:
    return _by_position(value, [_DIGITS] * len(value), tweak, f, back)


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    doubled = [int(c) * (1 + (i % 2 == 0)) for i, c in enumerate(reversed(digits))]
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def _is_card(value: str) -> bool:
    number = value.replace(" ", "").replace("-", "")
    return luhn(number[:-1]) == int(number[-1])


def _card(m: re.Match, f: Feistel, back: bool) -> str | None:
    if not _is_card(m[0]):
        return None
    number = re.sub(r"[ -]", "", m[0])
    payload = _digits(number[:-1], "card", f, back)
    return _kept_layout(m[0], payload + str(luhn(payload)))


def _iban_check(country: str, account: str) -> str:
    as_number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(as_number) % 97:02d}"


def _is_iban(value: str) -> bool:
    value = value.replace(" ", "")
    return _iban_check(value[:2], value[4:]) == value[2:4]


def _iban(m: re.Match, f: Feistel, back: bool) -> str | None:
    if not _is_iban(m[0]):
        return None
    value = m[0].replace(" ", "")
    country, account = value[:2], value[4:]
    new = _by_position(account, [_DIGITS if c.isdigit() else _UPPER for c in account], "iban" + country, f, back)
    return _kept_layout(m[0], country + _iban_check(country, new) + new)


def _phone(m: re.Match, f: Feistel, back: bool) -> str | None:
    """The digits after the country code; equal numbers stay linked across layouts."""
    digits = re.sub(r"\D", "", m["rest"])
    if not 7 <= len(digits) <= 13:
        return None
    return m["code"] + _kept_layout(m["rest"], _digits(digits, "phone" + re.sub(r"\D", "", m["code"]), f, back))


def _local_phone(m: re.Match, f: Feistel, back: bool) -> str | None:
    """Ten digits without a country code, area and exchange beginning with 2 to 9."""
    digits = re.sub(r"\D", "", m[0])
    if digits[0] < "2" or digits[3] < "2":
        return None
    alphabets = [_DIGITS[2:] if i in (0, 3) else _DIGITS for i in range(10)]
    return _kept_layout(m[0], _by_position(digits, alphabets, "local phone", f, back))


def _social(m: re.Match, f: Feistel, back: bool) -> str | None:
    """Nine digits whose parts are not all zeros and whose area is in use: numbered, permuted, written again."""
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    x = f.permute(x, len(areas) * 99 * 9999, "social", back)
    x, serial = divmod(x, 9999)
    at, group = divmod(x, 99)
    return f"{areas[at]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(m: re.Match, f: Feistel, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    x = f.permute(int.from_bytes(bytes(parts)), 2**32, "address", back)
    return ".".join(map(str, x.to_bytes(4)))


def _date(m: re.Match, f: Feistel, back: bool) -> str | None:
    """A day of two centuries, in its own layout; equal days stay linked across layouts."""
    layout = next(k for k in _LAYOUTS if m[k])
    order, mark = _LAYOUTS[layout]
    try:
        day = dt.date(**{k: int(v) for k, v in zip(order, m[0].split(mark))}).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    new = dt.date.fromordinal(_FIRST_DAY + f.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date", back))
    return mark.join(f"{getattr(new, k):0{4 if k == 'year' else 2}d}" for k in order)


def _classes(value: str, hexadecimal: bool = False) -> list[str]:
    if hexadecimal:
        return [_DIGITS + "abcdef"] * len(value)
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), c) for c in value]


def _mail(m: re.Match, f: Feistel, back: bool) -> str | None:
    """The part before the @, letters to letters and digits to digits; the domain stays."""
    name = m["name"]
    return _by_position(name, _classes(name), "mail" + m["domain"].lower(), f, back) + m["domain"]


def _secret(m: re.Match, f: Feistel, back: bool) -> str | None:
    value = m["value"] or m["key"]
    is_hex = re.compile(r"[0-9a-f]+").fullmatch
    hexadecimal = is_hex(value) is not None
    new = _by_position(value, _classes(value, hexadecimal), "secret", f, back)
    while not hexadecimal and is_hex(new):  # each of the two formats is permuted in itself
        new = _by_position(new, _classes(new), "secret", f, back)
    return m[0][: m.start("value" if m["value"] else "key") - m.start()] + new + m[0][m.end("value" if m["value"] else "key") - m.start() :]


# (start, end, rank) of what may be a value by its layout; of several from one start, the least rank comes first.
Places = Iterator[tuple[int, int, int]]


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    core: re.Pattern  # without what must stand before and after
    renew: Callable[[re.Match, Feistel, bool], str | None]
    sign: str = ""  # what every such value holds
    places: Callable[[str], Places] | None = None  # if not those of the pattern
    passes: Callable[[str], bool] | None = None  # the check of a value, if it depends on one

    def found(self, text: str) -> Places:
        if self.places:
            return self.places(text)
        return ((m.start(), m.end(), 0) for m in self.pattern.finditer(text))


# Layouts of dates: their parts in order and the mark between them.
_LAYOUTS = {"iso": (("year", "month", "day"), "-"), "dots": (("day", "month", "year"), "."), "slashes": (("month", "day", "year"), "/")}
_ALONE = r"(?<![\w.+-])", r"(?![\w-]|[.]\d)"


# Lengths of IBANs by country, from the registry; a number of another length or country is tried at the ends of groups.
_IBAN_LENGTHS = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_IBAN_HEAD = re.compile(_ALONE[0] + r"[A-Z]{2}\d{2}(?=[ A-Z0-9])", re.ASCII)
_GROUP, _TAIL = re.compile(r" ?[A-Z0-9]{4}"), re.compile(r" ?[A-Z0-9]{1,3}")
_DIGIT_RUN, _DIGIT_GROUP = re.compile(r"\d(?:[ -]?\d){12,}", re.ASCII), re.compile(r"\d+", re.ASCII)
_BEFORE, _AFTER = (re.compile(x, re.ASCII) for x in _ALONE)


def _iban_places(text: str) -> Places:
    """From each head, all ends that stand alone."""
    for head in _IBAN_HEAD.finditer(text):
        at, size, fixed = head.end(), 4, _IBAN_LENGTHS.get(head[0][:2])
        for n in range(1, 8):
            group = _GROUP.match(text, at)
            if not group:
                break
            at, size = group.end(), size + 4
            if n < 2:
                continue
            for end in {at, *(at + k for k in range(1, 5) if (m := _TAIL.fullmatch(text, at, at + k)) and m.end() == at + k)}:
                if _AFTER.match(text, end):
                    letters = size + len(text[at:end].strip())
                    yield head.start(), end, 0 if letters == fixed else 100 - letters


def _card_places(text: str) -> Places:
    """All 13 to 19 digits from the beginning of a group to the end of one, within each run of groups."""
    for run in _DIGIT_RUN.finditer(text):
        groups = [m.span() for m in _DIGIT_GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            if i == 0 and not _BEFORE.match(text, start):
                continue
            size = 0
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                if size >= 13 and (j + 1 < len(groups) or _AFTER.match(text, groups[j][1])):
                    yield start, groups[j][1], 19 - size


def _kind(name: str, pattern: str, renew: Callable, before: str = _ALONE[0], after: str = _ALONE[1], sign: str = "", places: Callable | None = None, passes: Callable | None = None) -> Kind:
    return Kind(name, re.compile(before + pattern + after, re.ASCII), re.compile(pattern, re.ASCII), renew, sign, places, passes)


# What stands after the word for a secret: signs of base64, tokens and paths belong to it, but not at its end. It begins with
# eight letters or digits, or holds both. What an @ follows is a mail name.
_SIGNS = r"[A-Za-z0-9+/_.~-]"
_SECRET = rf"(?P<value>(?={_SIGNS}{{8,}}+(?!@))(?=[A-Za-z0-9]{{8}}|(?={_SIGNS}*[A-Za-z]){_SIGNS}*[0-9])[A-Za-z0-9]{_SIGNS}{{6,}}[A-Za-z0-9])"

KINDS = (
    _kind("mail", r"(?P<name>[A-Za-z0-9._%+-]++)(?P<domain>@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)", _mail, r"(?<![A-Za-z0-9._%+-])", r"(?![\w-])", "@", passes=lambda _: True),
    _kind("secret", r"(?:(?i:password|passwd|pwd|secret|token|api_key)\s?[=:]\s?[\"']?" + _SECRET + r"|(?P<key>(?<=AKIA)[A-Z0-9]{16}|(?<=ghp_)[A-Za-z0-9]{36}))", _secret, "", r"", passes=lambda _: True),
    _kind("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _iban, places=_iban_places, passes=_is_iban),
    _kind("card", r"\d(?:[ -]?\d){12,18}", _card, places=_card_places, passes=_is_card),
    _kind("phone", r"(?P<code>\+\d{1,3}[ .-]?)(?P<rest>(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{1,4}){1,4})", _phone, r"(?<![\w+])", r"(?!\d)", "+"),
    _kind("phone", r"(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}", _local_phone, sign="-"),
    _kind("social", r"\d{3}-\d{2}-\d{4}", _social, sign="-"),
    _kind("address", r"\d{1,3}(?:\.\d{1,3}){3}", _address, sign="."),
    _kind("date", r"(?:(?P<iso>\d{4}-\d{2}-\d{2})|(?P<dots>\d{2}\.\d{2}\.\d{4})|(?P<slashes>\d{2}/\d{2}/\d{4}))", _date, after=rf"(?:(?=T\d{{2}}:\d{{2}})|{_ALONE[1]})"),
)
_PHONE, _ADDRESS = (next(k for k in KINDS if k.name == name) for name in ("phone", "address"))
_LOCAL = next(k for k in KINDS if k.renew is _local_phone)
_LONGEST = 64  # no value that may fail its check is longer
# Every finding holds a digit, an @ or one of the words before secrets.
_ANY = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|api_key|ghp_)")


def _passes(k: Kind, text: str, start: int, stop: int, f: Feistel, back: bool) -> bool:
    if k.passes:
        return k.passes(text[start:stop])
    m = k.core.fullmatch(text, start, stop)
    return m is not None and k.renew(m, f, back) is not None


def _renewed(text: str | list[str], start: int, stop: int, k: Kind, rivals: list[tuple[int, int, int]], f: Feistel, back: bool) -> str:
    """The first value of the walk beside which all rivals, that would come before it, still fail their check."""
    low = max(0, min([start, *[x[0] for x in rivals]]) - 8)  # with what may have to stand before
    held = "".join(text[low : max([stop, *[x[2] for x in rivals]])])
    a, b = start - low, stop - low
    while True:
        new = k.renew(k.core.fullmatch(held, a, b), f, back)
        held = held[:a] + new + held[b:]
        if not any(_passes(KINDS[order], held, x - low, y - low, f, back) for x, order, y in rivals):
            return new


def _renewed_address(text: str | list[str], begin: int, start: int, stop: int, f: Feistel, back: bool) -> str:
    """The same for an address: its dots move, so phones from ``begin`` on that would reach into it are looked for again."""
    low = max(0, begin - 1, start - _LONGEST)
    held = "".join(text[low : stop + _LONGEST])
    a, b = start - low, stop - low
    while True:
        new = _ADDRESS.renew(_ADDRESS.core.fullmatch(held, a, b), f, back)
        held, b = held[:a] + new + held[b:], a + len(new)
        if not any(begin - low <= x < a < y and _passes(_PHONE, held, x, y, f, back) for x, y, _ in _PHONE.found(held)):
            return new


def findings(text: str, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, new value) of all values that pass their check, in order, without overlaps."""
    if not _ANY.search(text):
        return []
    tried = sorted((start, order, rank, end) for order, k in enumerate(KINDS) if k.sign in text for start, end, rank in k.found(text))
    chosen, free, end = [], [], 0
    for start, order, _, stop in tried:
        if start >= end:
            if _passes(KINDS[order], text, start, stop, f, back):
                chosen.append((start, order, stop))
                end = stop
            else:
                free.append((start, order, stop))  # would be chosen, if it passed
    # Forward from the left, back from the right: what stands beside a value is the same when it is renewed and revealed.
    out, now = [], list(text) if chosen and free else text
    for n in reversed(range(len(chosen))) if back else range(len(chosen)):
        start, order, stop = chosen[n]
        if KINDS[order] is _ADDRESS:
            # A phone with its country code would come before one without.
            begin = next((c[2] for c in reversed(chosen[:n]) if KINDS[c[1]] is not _LOCAL), 0)
            new = _renewed_address(now, begin, start, stop, f, back)
        else:
            near = free[bisect_left(free, (start - _LONGEST,)) : bisect_left(free, (stop,))]
            new = _renewed(now, start, stop, KINDS[order], [x for x in near if x[2] > start], f, back)
        out.append((start, stop, KINDS[order].name, new))
        if free and len(new) == stop - start:
            now[start:stop] = new
    return sorted(out)


def rewrite(text: str, f: Feistel, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where they now stand."""
    parts, spans, at, size = [], [], 0, 0
    for start, end, name, new in findings(text, f, back):
        parts += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), name))
        size += len(new)
        at = end
    return "".join([*parts, text[at:]]), spans


SPANS = "array<struct<start:int,end:int,kind:string>>"


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; if ``spans`` is given, a column with where they stand."""
    held = [c for c in docs.columns if c != spans]
    rows = docs.select(*[F.col(f"`{c}`") for c in held])
    schema = StructType([*rows.schema.fields]).add(spans, kind(SPANS)) if spans else rows.schema
    where = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [(None, []) if t is None else rewrite(t, f, back) for t in batch.column(text).to_pylist()]
            at = batch.schema.get_field_index(text)
            out = batch.set_column(at, text, pa.array([t for t, _ in done], batch.schema.field(at).type))
            if spans:
                out = out.append_column(spans, pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done], where))
            yield out

    return rows.mapInArrow(run, schema)


def reveal(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, text, back=True)
