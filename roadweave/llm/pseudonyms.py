"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations within each value's format."""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import arrow_rows

KINDS = ("email", "card", "iban", "ip", "ssn", "phone", "date", "secret")
ROUNDS = 8
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

_PATTERN = re.compile(
    r"""
    (?P<email> [A-Za-z0-9._%+-]+ @ (?:[A-Za-z0-9-]+\.)+ [A-Za-z]{2,} )
  | (?P<secret> (?<![A-Za-z0-9]) AKIA [0-9A-Z]{16} (?![A-Za-z0-9]) | (?<= password= ) [!-~]{6,} | (?<= token\x20=\x20" ) [^"\s]{8,} (?=") )
  | (?P<iban> (?<![A-Za-z0-9]) [A-Z]{2} [0-9]{2} (?: \x20? [A-Z0-9]{4} ){2,7} (?: \x20? [A-Z0-9]{1,3} )? (?![A-Za-z0-9]) )
  | (?P<date> (?<![0-9./-]) (?: (?:19|20)[0-9]{2} (?P<_y>[-/.]) [0-9]{1,2} (?P=_y) [0-9]{1,2} | [0-9]{1,2} (?P<_d>[-/.]) [0-9]{1,2} (?P=_d) (?:19|20)[0-9]{2} ) (?! [0-9] | [./-][0-9] ) )
  | (?P<ip> (?<![0-9.]) (?<!ersion\x20) (?<![vV]) (?: [0-9]{1,3} \. ){3} [0-9]{1,3} (?! [0-9] | \.[0-9] ) )
  | (?P<ssn> (?<![0-9-]) [0-9]{3} - [0-9]{2} - [0-9]{4} (?! [0-9] | -[0-9] ) )
  | (?P<phone> (?<![0-9A-Za-z+]) (?: \+ [0-9]{1,3} [\x20.-]? (?: \( [0-9]{1,5} \) [\x20.-]? )? [0-9]{2,12} (?: [\x20./-] [0-9]{2,8} ){0,4}
                                  | \( [0-9]{3} \) \x20? [0-9]{3} [-.\x20] [0-9]{4} | [0-9]{3} (?P<_p>[-.]) [0-9]{3} (?P=_p) [0-9]{4}
                                  | (?<![0-9][./-]) (?: \( 0 [1-9][0-9]{1,4} \) \x20? | 0 [1-9][0-9]{1,4} [\x20/-] ) [0-9]{3,8} (?: [\x20-] [0-9]{2,5} ){0,2} ) (?! [0-9] | [./-][0-9] ) )
  | (?P<card> (?<![0-9A-Za-z.,-]) [3-6] (?: [\x20-]? [0-9] ){12,18} (?! [0-9A-Za-z] | [.,-][0-9] ) )
    """,
    re.VERBOSE,
)
_HINT = re.compile(r'[0-9@]|AKIA|password=|token = "')  # every pattern holds one of these
_NATIONAL = re.compile(r"\(?0[1-9]")
_AMERICAN = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}")
#: The country codes of one and of two digits; all others have three.
_COUNTRY = re.compile(
    r"\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98|[0-9]{1,3})"
)


class Permutation:
    """A keyed permutation of range(n): Feistel rounds on two coordinates, repeated until the value is in the range."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
        self.b = -(-n // self.a)
        self.bytes = (max(self.a, self.b).bit_length() + 71) // 8
        self.key = hashlib.blake2b(f"{tweak}|{n}".encode(), key=key, digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.key + bytes([i]) + x.to_bytes(self.bytes, "big")).digest(self.bytes), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right)) % self.a
            right = (right + self._f(i + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left)) % self.b
            left = (left - self._f(i, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        step = self._back if back else self._once
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x


def _alphabets(text: str) -> list[str]:
    """What may stand at each place: a digit, a lower-case letter, a capital, or just the character that stands there."""
    return [next((s for s in (_DIGITS, _LOWER, _UPPER) if c in s), c) for c in text]


def _permuted(text: str, alphabets: list[str], key: bytes, tweak: str, back: bool) -> str:
    number = 0
    for c, s in zip(text, alphabets, strict=True):
        number = number * len(s) + s.index(c)
    number = Permutation(key, tweak, math.prod(map(len, alphabets)))(number, back)
    out = []
    for s in reversed(alphabets):
        number, i = divmod(number, len(s))
        out.append(s[i])
    return "".join(reversed(out))


def _refill(text: str, fresh: str, of: str = _DIGITS) -> str:
    """The characters of `fresh` in the places of the characters of text that are in `of`."""
    it = iter(fresh)
    return "".join(next(it) if c in of else c for c in text)


def _luhn(digits: str) -> int:
    """Check digit after these digits."""
    return -sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, domain = text.split("@")
    return _permuted(local, _alphabets(local), key, f"email|{domain.lower()}|{''.join(a[0] for a in _alphabets(local))}", back) + "@" + domain


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in text if c in _DIGITS)
    if not 13 <= len(digits) <= 19 or _luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = digits[0] + _permuted(digits[1:-1], [_DIGITS] * (len(digits) - 2), key, f"card|{digits[0]}", back)
    return _refill(text, body + str(_luhn(body)))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    shape = _alphabets(plain[4:])
    body = _permuted(plain[4:], shape, key, f"iban|{plain[:2]}|{''.join(a[0] for a in shape)}", back)
    return _refill(text, f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}", _DIGITS + _UPPER)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = Permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = Permutation(key, "ssn", 898 * 99 * 9999)(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code, or the first two digits of a number with its national prefix, stay."""
    head, least = "", 7
    if text[0] == "+":
        head = _COUNTRY.match(text)[0]
    elif not _AMERICAN.fullmatch(text):
        head, least = _NATIONAL.match(text)[0], 9
    digits = "".join(c for c in text[len(head) :] if c in _DIGITS)
    if not least <= len(digits) + sum(c in _DIGITS for c in head) <= 15 or len(digits) < 6:
        return None
    return head + _refill(text[len(head) :], _permuted(digits, [_DIGITS] * len(digits), key, f"phone|{head.lstrip('(')}", back))


def _date(text: str, key: bytes, back: bool) -> str | None:
    a, mark, b, _, c = re.split(r"([-/.])", text)
    year_first = len(a) == 4
    year, x, y = (a, b, c) if year_first else (c, a, b)
    month_first = year_first or mark == "/" and int(x) <= 12  # 1/2/2020 is read as January 2; 13/2/2020 can only be February 13
    try:
        day = datetime.date(int(year), *map(int, (x, y) if month_first else (y, x))).toordinal()
    except ValueError:
        return None
    # order and widths are part of the format: a slashed date stays in the same one only if its day is beyond 12 or its month leads
    late = mark == "/" and not month_first
    widths = (len(x), len(y)) if month_first else (len(y), len(x))
    slashed = f"{month_first}" if mark == "/" and not year_first else ""
    days, ranks = _days(late, *widths)
    tweak = "date" if (late, *widths) == (False, 2, 2) and not slashed else f"date|{slashed}|{widths}"
    new = datetime.date.fromordinal(days[Permutation(key, tweak, len(days))(ranks[day], back)])
    x, y = f"{new.month:0{widths[0]}d}", f"{new.day:0{widths[1]}d}"
    x, y = (x, y) if month_first else (y, x)
    return f"{new.year}{mark}{x}{mark}{y}" if year_first else f"{x}{mark}{y}{mark}{new.year}"


_DAYS: dict[tuple[bool, int, int], tuple[list[int], dict[int, int]]] = {}


def _days(late: bool, month_width: int, day_width: int) -> tuple[list[int], dict[int, int]]:
    """The days that can be written in these widths (of one digit: 1 to 9), late ones after the 12th, and their ranks."""
    shape = late, month_width, day_width
    if shape not in _DAYS:
        fits = lambda d: (d.day > 12 or not late) and (d.month < 10 or month_width == 2) and (d.day < 10 or day_width == 2)
        days = [d for d in range(_FIRST_DAY, _LAST_DAY + 1) if fits(datetime.date.fromordinal(d))]
        _DAYS[shape] = days, {d: i for i, d in enumerate(days)}
    return _DAYS[shape]


def _secret(text: str, key: bytes, back: bool) -> str | None:
    if re.fullmatch("AKIA[0-9A-Z]{16}", text):
        return "AKIA" + _permuted(text[4:], [_DIGITS + _UPPER] * 16, key, "AKIA", back)
    if re.fullmatch("[0-9a-f]+", text):
        return _permuted(text, [_DIGITS + "abcdef"] * len(text), key, "hex", back)
    return _permuted(text, _alphabets(text), key, "secret|" + "".join(a[0] if len(a) > 1 else "=" for a in _alphabets(text)), back)


_MAKERS = {"email": _email, "card": _card, "iban": _iban, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date, "secret": _secret}


def _tries(kind: str, text: str) -> list[str]:
    """A match and, for patterns that run into the words or numbers behind a value, its shorter beginnings by whole groups, longest first."""
    least = {"card": 13, "iban": 15, "phone": 7}.get(kind)
    if least is None:
        return [text]
    ends = [i for i, c in enumerate(text) if c in " -/." and sum(x.isalnum() for x in text[:i]) >= least]
    return [text, *(text[:i] for i in reversed(ends))]


def _fresh(kind: str, text: str, key: bytes, back: bool) -> tuple[str, str] | None:
    """The longest valid value that a match begins with, and its pseudonym."""
    make, tries = _MAKERS[kind], _tries(kind, text)
    for k, value in enumerate(tries):
        fresh = make(value, key, back)
        # a pseudonym that validates together with what follows would not be found again: the next one of its cycle is taken
        while fresh is not None and any(make(fresh + longer[len(value) :], key, back) is not None for longer in tries[:k]):
            fresh = make(fresh, key, back)
        if fresh is not None:
            return value, fresh
    return None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its personal values permuted, and (begin, end, kind) of each in the input; back restores it."""
    if not _HINT.search(text):
        return text, []
    out, spans, at = [], [], 0
    m = _PATTERN.search(text)
    while m:
        kind = next(k for k in KINDS if m[k])
        found = _fresh(kind, m[0], key, back)
        begin, end = m.start(), m.start() + 1  # within a match that doesn't validate the search goes on
        if found is not None:
            end = begin + len(found[0])
            out += [text[at:begin], found[1]]
            spans.append((begin, end, kind))
            at = end
        m = _PATTERN.search(text, end)
    return "".join([*out, text[at:]]), spans


def replace(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, spans) per row: personal values replaced, spans (begin, end, kind) of the values in the input text.

    Cards (Luhn), account numbers (mod 97), addresses of four bytes, social security numbers, telephone numbers, dates
    of 1900 to 2099, e-mail names, access keys, passwords and tokens are validated and permuted among the valid values
    of the same format under the secret, so a value has the same pseudonym in every document and who holds the secret
    can go back. Telephone numbers are international, North American, or national with a leading zero and at least nine
    digits; country codes stay. A date keeps its order and the widths of its day and month, so one day has one pseudonym in
    each of these formats; with four-digit year first or dots, and two digits each, it is the same one. Four bytes after
    "v" or "version" are a version. A card or account number that digits or capitals follow is found by the groups it ends with, and the search
    goes on inside what doesn't validate, which stays as it is. Null texts stay null, with no spans; null keys and repeated rows
    are kept; an empty table gives no rows; other columns are not read. Whole texts are searched.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        found = [(None, []) if t is None else pseudonymise(t, secret) for t in batch.column(1).to_pylist()]
        spans = [[{"begin": a, "end": b, "kind": k} for a, b, k in s] for _, s in found]
        return {key: batch.column(0), text: [t for t, _ in found], "spans": spans}

    return arrow_rows(docs.select(key, text), f"`{key}` {kind}, `{text}` string, spans array<struct<begin:int,end:int,kind:string>>", make)


def replace_texts(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """docs with all its columns, and the values in its texts replaced as by `replace`."""

    @F.pandas_udf("string")
    def fresh(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pseudonymise(t, secret)[0] for t in texts], dtype=object)

    return docs.withColumn(text, fresh(F.col(text)))
