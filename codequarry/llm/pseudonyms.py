"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and validated; each is then permuted within the
set of all valid values of its format by a keyed Feistel network, walking its
cycle until the result is valid again.  A value therefore always gets the same
pseudonym, in every document, and different values get different ones.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY

_VALUE = re.compile(r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
  | (?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))
  | (?P<iso>(?<!\w)\d{4}-\d{2}-\d{2}(?!\w|-\d))
  | (?P<dotted>(?<![\w.])\d{1,2}[./]\d{1,2}[./]\d{4}(?!\w|[./]\d))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d))
  | (?P<phone>(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)
      |(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?!\w))
  | (?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w|-\d))
""", re.VERBOSE | re.ASCII)


def permute(x: int, size: int, key: bytes, kind: str, valid: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the valid numbers below ``size``.

    Two halves of about equal range are shifted by keyed hashes of each other;
    results outside the range, or not valid, are permuted again.
    """
    wide = isqrt(size - 1) + 1
    high = -(-size // wide)
    while True:
        left, right = divmod(x, wide)
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + _shift(left, turn, size, key, kind)) % wide
            else:
                left = (left + _shift(right, turn, size, key, kind)) % high
        x = left * wide + right
        if x < size and valid(x):
            return x


def _shift(half: int, turn: int, size: int, key: bytes, kind: str) -> int:
    data = f"{kind}|{size}|{turn}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def _ranges(text: str) -> list[tuple[str, int]]:
    """The alphabet of each character that is permuted; the others are fixed."""
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [(a, i) for i, c in enumerate(text) for a in kinds if c in a]


def _characters(text: str, key: bytes, kind: str, valid: Callable[[str], bool] = lambda _: True) -> str:
    """Letters and digits permuted together, each within its own kind."""
    ranges = _ranges(text)
    x, size = 0, 1
    for alphabet, i in ranges:
        x, size = x * len(alphabet) + alphabet.index(text[i]), size * len(alphabet)

    def spelled(value: int) -> str:
        out = list(text)
        for alphabet, i in reversed(ranges):
            value, at = divmod(value, len(alphabet))
            out[i] = alphabet[at]
        return "".join(out)

    return spelled(permute(x, size, key, kind, lambda v: valid(spelled(v)))) if size > 1 else text


def _laid_over(pattern: str, digits: str) -> str:
    """The characters of ``digits`` in the places of the letters and digits of ``pattern``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = sum(int(c) for c in digits[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _iban_rest(body: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[0] + _characters(digits[1:-1], key, "card")
    return _laid_over(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _iban(text: str, key: bytes) -> str | None:
    packed = text.replace(" ", "")
    country, check, body = packed[:2], packed[2:4], packed[4:]
    if 98 - _iban_rest(body, country) != int(check):
        return None
    new = _characters(body, key, "iban" + country)
    return _laid_over(text, f"{country}{98 - _iban_rest(new, country):02d}{new}")


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    new = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(str(b) for b in new.to_bytes(4, "big"))


def _day(year: str, month: str, day: str, key: bytes) -> dt.date | None:
    try:
        number = dt.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return dt.date.fromordinal(FIRST_DAY + permute(number, DAYS, key, "day")) if 0 <= number < DAYS else None


def _iso(text: str, key: bytes) -> str | None:
    new = _day(*text.split("-"), key)
    return new and new.isoformat()


def _dotted(text: str, key: bytes) -> str | None:
    """``d.m.yyyy``; with slashes ``m/d/yyyy`` where that is a date, else ``d/m/yyyy``."""
    mark = "/" if "/" in text else "."
    first, second, year = re.split(r"[./]", text)
    as_month = mark == "/" and int(first) <= 12
    new = _day(year, first, second, key) if as_month else _day(year, second, first, key)
    if new is None:
        return None
    pair = (new.month, new.day) if as_month else (new.day, new.month)
    wide = 2 if len(first) == len(second) == 2 else 1
    return mark.join(f"{x:0{wide}d}" for x in pair) + f"{mark}{new.year:04d}"


def _ssn_valid(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def _phone_valid(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return not text.startswith("+1") or len(digits) != 11 or (digits[1] > "1" and digits[4] > "1")


def _phone(text: str, key: bytes) -> str | None:
    if not 7 <= len(re.sub(r"\D", "", text)) <= 15 or not _phone_valid(text):
        return None
    country = re.match(r"\+\d{1,3}(?=[ .(-])|", text, re.ASCII)[0]
    return country + _characters(text[len(country):], key, "phone" + country, lambda s: _phone_valid(country + s))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    return _characters(local, key, "email@" + domain.lower()) + "@" + domain


_KINDS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "iban": _iban, "ip": _ip, "iso": _iso, "dotted": _dotted, "phone": _phone, "card": _card,
    "ssn": lambda text, key: _characters(text, key, "ssn", _ssn_valid) if _ssn_valid(text) else None,
}


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of one value, or None where it is not valid."""
    return _KINDS[kind](text, key)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the kind and place in the old text of each."""
    spans: list[tuple[str, int, int]] = []

    def swap(found: re.Match) -> str:
        new = pseudonym(found.lastgroup, found[0], key)
        if new is None:
            return found[0]
        spans.append((found.lastgroup, *found.span()))
        return new

    return _VALUE.sub(swap, text), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
_CLUE = re.compile(r"[0-9@]")


def pseudonymised(docs: DataFrame, key: bytes, spans: str | None = None) -> DataFrame:
    """The rows of ``docs`` with pseudonyms in ``text``; with ``spans``, a column of that name lists what was replaced.

    A null text stays null and an empty one empty, texts without values stay
    as they are, whole texts are searched, rows may repeat, and all other
    columns pass through.  Nothing is shuffled, and ``key`` is never written.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}"
    if spans:
        schema += f", `{spans}` array<struct<kind:string,begin:int,end:int>>"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at):
                text = value.as_py()
                new, places = replaced(text, key) if text and _CLUE.search(text) else (text, [])
                texts.append(new)
                found.append([{"kind": k, "begin": b, "end": e} for k, b, e in places])
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            names = list(batch.schema.names)
            if spans:
                columns.append(pa.array(found, SPANS))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
