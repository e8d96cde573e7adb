"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (check digits, calendar, ranges), numbered within
their format, put through a keyed permutation of that number range, and written
back in the same format. Equal values get equal pseudonyms in every document,
valid values stay valid, and the key holder can turn them back.

The permutation E is a balanced Feistel network (8 rounds of keyed BLAKE2b) over
the next even number of bits, walked until it falls into the range. What is used
is D(E(x) + 1 mod N), a permutation without fixed points: no value is its own
pseudonym.

Kinds: card (13 to 19 digits, Luhn), iban (ISO 7064 mod 97), ssn (ddd-dd-dddd),
phone (international with +, North American with separators, a leading 1 or
not), ip (four octets), date (ISO, with dots, with slashes, with English month
names; days and months of one or two digits keep their width; either end of a
range; 1900 to 2099), email (letters and digits of the part before the @, 64 characters at most: of a
longer run its last ones are the address). Values inside longer words or numbers
are left alone, as are numbers that fail validation. Finding and replacing take
time in proportion to the text, whatever it holds.

Rules for odd input: a null text stays null without findings; an empty text
stays empty; repeated rows are treated alike; an empty table gives an empty
result; the other columns pass through, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seekrank.llm import common

ROUNDS = 8
_DAY0, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points (for size 1 the identity)."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        seed = hashlib.blake2b(f"{kind}:{size}".encode(), key=key, digest_size=32).digest()
        self.keys = [hashlib.blake2b(bytes([r]), key=seed, digest_size=32).digest() for r in range(ROUNDS)]

    def _f(self, r: int, x: int) -> int:
        n = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(n, "big"), key=self.keys[r], digest_size=min(64, n + 8)).digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        if back:
            for r in range(ROUNDS - 1, -1, -1):
                left, right = right ^ self._f(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ self._f(r, right)
        return left << self.half | right

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x

    def __call__(self, x: int, back: bool = False) -> int:
        return self._walk((self._walk(x, False) + (-1 if back else 1)) % self.size, True)


def luhn_digit(digits: str) -> int:
    """The check digit that makes ``digits`` and it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, bban: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97


def refill(pattern: str, chars: str) -> str:
    """``pattern`` with its letters and digits replaced, in order, by ``chars``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


class Pseudonyms:
    """All formats under one key; ``back`` undoes what was done."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key[:64], back
        self.value = lru_cache(100_000)(self._value)
        self.permutation = lru_cache(1000)(lambda kind, size: Permutation(self.key, kind, size))

    def _map(self, kind: str, x: int, size: int) -> int:
        return self.permutation(kind, size)(x, self.back)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._map(kind, int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None where the value isn't valid."""
        return getattr(self, kind)(text)

    def card(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if luhn_digit(d[:-1]) != int(d[-1]):
            return None
        body = self._digits("card", d[:-1])
        return refill(text, body + str(luhn_digit(body)))

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        country, bban = flat[:2], flat[4:]
        if not 15 <= len(flat) <= 34 or iban_check(country, bban) != int(flat[2:4]):
            return None
        digits = iter(self._digits("iban" + country, re.sub(r"\D", "", bban)))
        bban = "".join(next(digits) if c.isdigit() else c for c in bban)
        return refill(text, f"{country}{iban_check(country, bban):02d}{bban}")

    def ssn(self, text: str) -> str | None:
        a, g, s = (int(x) for x in text.split("-"))
        if a in (0, 666) or a > 899 or not g or not s:
            return None
        x = self._map("ssn", ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999)
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def phone(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if not 8 <= len(d) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})\D", text)  # a country code set apart stays; one that isn't: its usual length
        keep = len(code[1]) if code else int(len(d) == 11) if text[0] != "+" else 1 if d[0] in "17" else 2
        return refill(text, d[:keep] + self._digits("phone", d[keep:]))

    def ip(self, text: str) -> str | None:
        o = [int(x) for x in text.split(".")]
        if max(o) > 255:
            return None
        x = self._map("ip", int.from_bytes(bytes(o), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        parts = re.findall(r"[0-9]+|[A-Za-z]+", text)
        named = next((i for i, p in enumerate(parts) if p.isalpha()), None)
        if named is not None:
            y, m, d = 2, named, 1 - named
        elif len(parts[0]) == 4:
            y, m, d = 0, 1, 2
        else:
            y, m, d = (2, 0, 1) if "/" in text and int(parts[0]) <= 12 else (2, 1, 0)
        month = int(parts[m]) if named is None else 1 + [n[:3] for n in MONTHS].index(parts[m][:3].lower())
        try:
            x = (datetime.date(int(parts[y]), month, int(parts[d])) - _DAY0).days
        except ValueError:
            return None
        if not 0 <= x < _DAYS:
            return None
        late = "/" in text and y and int(parts[0]) > 12  # day first with slashes: stay on days that show it

        def fits(day: datetime.date) -> bool:  # what is written can be read back in the same way
            return ((not late or day.day > 12) and (len(parts[d]) == 2 or day.day < 10)
                    and ((day.month == 5) == (month == 5) if named is not None else len(parts[m]) == 2 or day.month < 10))  # May is long and short
        while True:
            x = self._map("date", x, _DAYS)
            day = _DAY0 + datetime.timedelta(x)
            if fits(day):
                break
        new = {y: f"{day.year:04d}", d: str(day.day).zfill(len(parts[d])), m: str(day.month).zfill(len(parts[m]))}
        if named is not None:
            name = MONTHS[day.month - 1] if len(parts[m]) > 3 or month == 5 else MONTHS[day.month - 1][:3]
            new[m] = name.upper() if parts[m].isupper() else name if parts[m].islower() else name.capitalize()
        it = iter([new[i] for i in range(3)])
        return re.sub(r"[0-9]+|[A-Za-z]+", lambda _: next(it), text)

    def email(self, text: str) -> str | None:
        local, domain = text.rsplit("@", 1)
        x, size = 0, 1
        sets = ["abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "0123456789" if c.isdigit() else "" for c in local]
        for c, s in zip(local, sets):
            if s:
                x, size = x * len(s) + s.index(c), size * len(s)
        if size == 1:
            return None
        shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in local)
        x, out = self._map("email" + shape, x, size), []
        for c, s in zip(reversed(local), reversed(sets)):
            if s:
                x, r = divmod(x, len(s))
                out.append(s[r])
            else:
                out.append(c)
        return "".join(reversed(out)) + "@" + domain


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAME = "(?:" + "|".join(f"{c(n)}|{c(n[:3])}" for n in MONTHS for c in (str.capitalize, str.upper, str.lower)) + ")"
_DATE = (r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
         rf"|{_NAME}\.? [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}}\.? {_NAME}\.?,? [0-9]{{4}})(?![0-9])")
#: After addresses, in this order at one place; a value that fails its check leaves the place to the later kinds.
_KINDS: tuple[tuple[str, str], ...] = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])\+1 ?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{1,4}){2,6}(?![0-9])"),
    ("phone", r"(?<![A-Za-z0-9+.-])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
    ("ssn", r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])"),
    ("date", rf"(?<![A-Za-z0-9./-]){_DATE}(?:[/-]{_DATE})*(?![A-SU-Za-z0-9]|[./-][0-9])"),  # ranges too
    ("ip", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])"),
    ("card", r"(?<![A-Za-z0-9.])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5})(?![A-Za-z0-9]|\.[0-9])"),
)
_FIND = [(k, re.compile(p)) for k, p in _KINDS]
_ONE_DATE = re.compile(_DATE)
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Characters before the @ that belong to an address at most; of a longer run the last ones count.
LOCAL_CHARS = 64


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of addresses: from every @ to the left over the characters a local part may have, then the domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and at - start < LOCAL_CHARS and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if any(c.isalnum() for c in text[start:at]) else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(low, at + 1))


def find(text: str) -> list[tuple[int, int, str]]:
    """Candidate places (start, end, kind), in order of kind; none for texts without digits and @."""
    out = [(start, end, "email") for start, end in find_emails(text)]
    for kind, p in _FIND if _DIGIT.search(text) else ():
        for m in p.finditer(text):
            own = _ONE_DATE.finditer(text, m.start(), m.end()) if kind == "date" else (m,)
            out += [(x.start(), x.end(), kind) for x in own]
    return out


def replace(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the places replaced (start, end, kind) in the original, by start."""
    found = find(text)
    if not found:
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    covered = bytearray(len(text))  # the characters of the places taken so far
    for start, end, kind in found:
        if covered.find(1, start, end) < 0:
            new = names.value(kind, text[start:end])
            if new is not None:
                taken.append((start, end, kind, new))
                covered[start:end] = b"\1" * (end - start)
    taken.sort()
    out, at = [], 0
    for start, end, _, new in taken:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [t[:3] for t in taken]


def pseudonymise(rows: DataFrame, key: bytes, text: str = "text", found: str | None = "pii", back: bool = False) -> DataFrame:
    """``rows`` with ``text`` replaced and, unless ``found`` is None, the places as ``kind:start:end`` by start, comma-joined.

    A map over the input: no shuffle, no state but the key.
    """
    schema = rows.schema
    names = rows.columns
    if found and found in names:
        rows, names = rows.drop(found), [n for n in names if n != found]
        schema = rows.schema
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonyms(key, back)
        for b in common.slices(batches, text):
            got = [("", []) if t is None else replace(t, worker) if t else (t, []) for t in b.column(place).to_pylist()]
            new = pa.array([g[0] for g in got], pa.string(), mask=b.column(place).is_null().to_numpy(zero_copy_only=False))
            cols = [new if i == place else c for i, c in enumerate(b.columns)]
            if found:
                cols.append(pa.array([",".join(f"{k}:{s}:{e}" for s, e, k in g[1]) for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names + ([found] if found else []))
    if found:
        schema = T.StructType([*schema.fields, T.StructField(found, T.StringType())])
    return rows.mapInArrow(run, schema)
