"""Format-preserving pseudonyms by a keyed Feistel network.

Card numbers (Luhn), phone numbers, IPv4 addresses, social-security-style numbers, IBANs (mod 97)
and dates are validated and replaced by other values of the same format; local parts of e-mail
addresses likewise.  A number is taken without what follows it if only then it is valid.  A phone
number has a country code, an area code in parentheses, a leading 0, or ten digits.  Dates of the
years 1900 to 2099 are permuted among themselves, and those of other years too.  The permutation
depends on the key and the kind only, so equal values get equal pseudonyms in all documents and
different values stay different.  Nothing is stored: no table of values, and no shuffle.

Cases: a null text stays null with zero counts; an empty text stays empty; texts of any length are
treated whole; where two kinds match at a place the first of ``PIECES`` that is valid wins, and no
match starts inside another; equal rows give equal rows; an empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import memory  # noqa: F401  for its effect on workers

KINDS = ("email", "iban", "card", "ip", "phone", "ssn", "date")
ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
OTHER_DAYS = dt.date.max.toordinal() - DAYS
#: Names of months in the corpus's languages; of a name in two, a day with a full stop tells German.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
NAMES = "|".join(sorted({re.escape(m) for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m)))
PIECE = 1 << 240

PIECES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4})(?![0-9]|\.[0-9])",
    "day": rf"(?<![0-9.])[0-9]{{1,2}}(?:\.|er|st|nd|rd|th)?\x20(?:de\x20|of\x20)?(?i:{NAMES}),?\x20(?:del?\x20)?[0-9]{{4}}(?![0-9])",
    "month": rf"\b(?i:{NAMES})\x20[0-9]{{1,2}}(?:st|nd|rd|th)?,?\x20[0-9]{{4}}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][.,/-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])|(?<![0-9A-Za-z+.,/-])0{1,2}[1-9][0-9]{0,3}(?:[\x20/.-][0-9]{2,8}){1,4}(?![0-9A-Za-z]|[.,/-][0-9])",
}
PATTERNS = {kind: re.compile(pattern) for kind, pattern in PIECES.items()}
PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PIECES.items()))
QUICK = re.compile(r"[0-9@]")
TRUNK = re.compile("0{1,2}[1-9]")


class Feistel:
    """A keyed permutation of the integers below ``size``: alternating rounds over two factors.

    The numbers below a * b >= size are split into a high and a low part; each round adds a keyed
    hash of one part to the other.  Results at or above ``size`` are permuted again.
    """

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.a = size, max(1, int(size**0.5))
        self.b = -(-size // self.a)
        self.inner = hmac.new(key, f"{kind}:{size}".encode(), hashlib.sha256).digest()

    def _round(self, k: int, part: int) -> int:
        return int.from_bytes(hashlib.blake2b(k.to_bytes(1, "big") + part.to_bytes(16, "big"), key=self.inner, digest_size=16).digest(), "big")

    def __call__(self, x: int) -> int:
        while True:
            high, low = divmod(x, self.b)
            for k in range(ROUNDS):
                if k % 2:
                    high = (high + self._round(k, low)) % self.a
                else:
                    low = (low + self._round(k, high)) % self.b
            x = high * self.b + low
            if x < self.size:
                return x

    def inverse(self, x: int) -> int:
        while True:
            high, low = divmod(x, self.b)
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    high = (high - self._round(k, low)) % self.a
                else:
                    low = (low - self._round(k, high)) % self.b
            x = high * self.b + low
            if x < self.size:
                return x


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """Pseudonyms of single values under one key."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.back = key, inverse

    @lru_cache(maxsize=256)  # noqa: B019  one object per worker
    def _feistel(self, kind: str, size: int) -> Callable[[int], int]:
        network = Feistel(self.key, kind, size)
        return network.inverse if self.back else network

    def _digits(self, kind: str, digits: str) -> str:
        return str(self._feistel(kind, 10 ** len(digits))(int(digits))).zfill(len(digits))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        body = self._digits("card", digits[:-1])
        return fill(text, body + str(-_luhn_sum(body + "0") % 10))

    def phone(self, text: str) -> str | None:
        head = re.match(r"\+[0-9]{1,3}(?=\D)|\+[0-9]", text)
        head = head[0] if head else ""
        digits = re.sub(r"\D", "", text[len(head) :])
        if not 7 <= len(digits) <= 14:
            return None
        if head or "(" in text:
            return head + fill(text[len(head) :], self._digits("phone", digits))
        if trunk := TRUNK.match(digits):  # the leading 0 or 00 and the region stay
            return fill(text, trunk[0] + self._digits("phone", digits[trunk.end() :]))
        if len(digits) != 10:
            return None
        new = self._digits("phone", digits)
        while TRUNK.match(new):
            new = self._digits("phone", new)
        return fill(text, new)

    def ip(self, text: str) -> str | None:
        parts = list(map(int, text.split(".")))
        if max(parts) > 255:
            return None
        value = self._feistel("ip", 1 << 32)(int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000":
            return None
        area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
        known = area - 1 - (area > 666)
        value = self._feistel("ssn", 898 * 99 * 9999)((known * 99 + group - 1) * 9999 + serial - 1)
        rest, serial = divmod(value, 9999)
        known, group = divmod(rest, 99)
        return f"{known + 1 + (known >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if len(bare) < 15 or _iban_rest(bare) != 1:
            return None
        body = self.alphanumeric("iban", bare[4:])
        check = 98 - _iban_rest(bare[:2] + "00" + body)
        new = iter(bare[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def alphanumeric(self, kind: str, text: str) -> str:
        """Digits stay digits, and letters letters of their case; other characters stay.

        Texts of more values than a network takes are permuted in pieces, each with the place of its start.
        """
        spans = [(10, "0123456789") if c in "0123456789" else (26, "abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z" else (26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if "A" <= c <= "Z" else (1, c) for c in text]
        out, at = [], 0
        while at < len(text):
            start, value, size = at, 0, 1
            while at < len(text) and size * spans[at][0] < PIECE:
                n, letters = spans[at]
                value, size, at = value * n + letters.index(text[at]), size * n, at + 1
            piece = spans[start:at]
            shape = "".join("0" if n == 10 else letters[0] for n, letters in piece)
            if size > 1:
                value = self._feistel(f"{kind}:{start}:{shape}" if start else f"{kind}:{shape}", size)(value)
            chars = []
            for n, letters in reversed(piece):
                value, k = divmod(value, n)
                chars.append(letters[k])
            out += reversed(chars)
        return "".join(out)

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{self.alphanumeric('email', local)}@{domain}"

    def _day(self, day: dt.date) -> dt.date:
        if FIRST_DAY <= day <= LAST_DAY:
            return FIRST_DAY + dt.timedelta(self._feistel("date", DAYS)((day - FIRST_DAY).days))
        first = FIRST_DAY.toordinal()
        place = day.toordinal() - 1 - (DAYS if day > LAST_DAY else 0)
        place = self._feistel("other date", OTHER_DAYS)(place)
        return dt.date.fromordinal(place + 1 + (DAYS if place + 1 >= first else 0))

    def date(self, text: str) -> str | None:
        """Years first; day first with full stops; month first with slashes and hyphens, unless the first is above 12.

        Days above 12 that come first stay above 12, so that no two such texts of one reading become one.
        """
        try:
            if text[4:5] == "-":
                return self._day(dt.date.fromisoformat(text)).isoformat()
            a, b, year = map(int, re.split(r"[./-]", text))
            mark = re.search(r"[./-]", text)[0]
            wide = 2 if len(re.split(r"[./-]", text)[0]) == 2 else 1
            if mark != "." and a > 12:
                new = self._day(dt.date(year, b, a))
                while new.day <= 12:
                    new = self._day(new)
                first, second = new.day, new.month
            elif mark != ".":
                new = self._day(dt.date(year, a, b))
                first, second = new.month, new.day
            else:
                new = self._day(dt.date(year, b, a))
                first, second = new.day, new.month
            return f"{first:0{wide}d}{mark}{second:0{wide}d}{mark}{new.year:04d}"
        except ValueError:
            return None

    def day(self, text: str) -> str | None:
        """A date with its month in words, in either order; ordinal endings go, since they depend on the day."""
        name = re.search(NAMES, text, re.I)
        number, year = re.findall("[0-9]+", text)
        known = [months for months in MONTHS.values() if name[0].lower() in map(str.lower, months)]
        months = MONTHS["de"] if MONTHS["de"] in known and f"{number}." in text else known[0]
        try:
            new = self._day(dt.date(int(year), [m.lower() for m in months].index(name[0].lower()) + 1, int(number)))
        except ValueError:
            return None
        word = months[new.month - 1]
        word = word.upper() if name[0].isupper() else word.lower() if name[0].islower() else word.capitalize()
        parts = {number: str(new.day), name[0]: word, year: f"{new.year:04d}"}
        return re.sub(rf"([0-9]+)(?:er|st|nd|rd|th)?|{re.escape(name[0])}", lambda m: parts[m[1] or m[0]], text)

    month = day

    def value(self, kind: str, text: str) -> tuple[str, int] | None:
        """The pseudonym and how many characters it stands for: all, or up to the last border at which the value is valid."""
        borders = [m.start() for m in re.finditer(r"[\x20-]", text)] if kind in ("card", "iban") else []
        for end in [len(text), *reversed(borders)]:
            part = text[:end]
            if end < len(text) and not PATTERNS[kind].fullmatch(part):
                continue
            new = getattr(self, kind)(part)
            if new is not None:
                return new, end
        return None

    def text(self, text: str, counts: list[int] | None = None) -> str:
        """The text with all values replaced; ``counts`` is raised at each kind.

        What fails the check of one kind is tried as the others, and then from its next border.
        """
        out, done, at = [], 0, 0
        while found := PATTERN.search(text, at):
            start, kind = found.start(), found.lastgroup
            new = self.value(kind, found[0])
            for other in PATTERNS if new is None else ():
                again = PATTERNS[other].match(text, start) if other != kind else None
                new = again and self.value(other, again[0])
                if new:
                    kind = other
                    break
            if new is None:
                at = start + 1
                continue
            out += [text[done:start], new[0]]
            done = at = start + new[1]
            if counts is not None:
                counts[KINDS.index("date" if kind in ("day", "month") else kind)] += 1
        return "".join([*out, text[done:]])


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, the text with pseudonyms, the number of replaced values in all and of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pseudonyms(key)
        for batch in batches:
            out, columns = [], [[] for _ in KINDS]
            for text in batch.column("text").to_pylist():
                counts = [0] * len(KINDS)
                out.append(own.text(text, counts) if text and QUICK.search(text) else text)
                for column, n in zip(columns, counts):
                    column.append(n)
            total = [sum(x) for x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string()), pa.array(total, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_replaced long, " + ", ".join(f"n_{k} long" for k in KINDS))
