"""Format-preserving pseudonyms for personal data, by a keyed Feistel network."""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
#: Digits and letters move within these: ASCII, Latin-1, Latin Extended-A, Greek and Cyrillic, lower and upper case apart.
ALPHABETS = ((0x61, 0x7B), (0x41, 0x5B), (0xC0, 0x100), (0x100, 0x180), (0x370, 0x400), (0x400, 0x460))
CLASSES = ("0123456789", *("".join(c for c in map(chr, range(*block)) if case(c)) for block in ALPHABETS for case in (str.islower, str.isupper)))
CLASS_OF = {c: own for own in CLASSES for c in own}
#: Rows that are worked on at once.
STEP = 500
#: No number reaches farther than so many characters.
NEAR = 80
#: Characters of a local part that are permuted together; longer ones are cut, from their end.
PIECE = 64
#: Characters of an IBAN, by country.
IBAN_SIZES = dict(re.findall("([A-Z]{2})([0-9]{2})", """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18
    FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
    LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24
    SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"""))


def _shorter(kind: str, found: str) -> list[str]:
    """What a match may stand for, longest first: itself, or its beginning up to a separator."""
    cuts = [m.start() for m in re.finditer(r"[ ./-]", found) if found[m.start() - 1] not in " ./-"]
    all_ = [found, *(found[:c] for c in reversed(cuts))]
    digits = lambda v: sum(c.isdigit() for c in v)
    if kind == "card":
        return [v for v in all_ if digits(v) >= 13]
    if kind == "iban":
        size = IBAN_SIZES.get(found[:2].upper())
        return [v for v in all_ if (v == found or not size or len(v.replace(" ", "")) == int(size)) and len(v.replace(" ", "")) >= 15]
    if kind == "international":
        return [v for v in all_ if 8 <= digits(v) <= 15 and v.count("(") == v.count(")")]
    return [found]

#: The local part of an address, of any length; an apostrophe may stand inside. Each run is tried once, from its beginning.
EMAIL = re.compile(r"(?<![\w.%+-])(?<![\w.%+-]')[\w.%+-]++(?:'[\w.%+-]++)*+(?=(@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}))")
IBAN = re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30}(?!\w)", re.ASCII)
CARD = re.compile(r"(?<![\w+-])(?<!\d\.)\d(?:[ -]?\d){12,18}(?!\w|-\w)")
#: The usual groups of card numbers.
GROUPS = re.compile(r"\d+|\d{4}([ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{4,5}")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")
#: A number with its country code, in groups of any sizes; at most 15 digits (E.164).
INTERNATIONAL = re.compile(r"(?<![\w.+])\+\d{1,4}(?:[ ./-]?(?:\(\d{1,5}\)|\d{1,14}))+(?!\w)")
#: A number within a country: a trunk 0 and an area code of up to four digits, the rest behind a space, a slash or a hyphen; a
#: trunk 0 and five pairs; three groups of three from 6 to 9 on.
NATIONAL = re.compile(
    r"(?<![\w.+/-])(?:\(0\d{1,4}\)[ /-]?\d{3,8}(?:[ -]\d{2,4}){0,2}|0\d(?:[ .]\d{2}){4}|0\d{1,4}(?: ?/ ?|[ -])\d{3,8}(?:[ -]\d{2,4}){0,2}|[6-9]\d{2}[ .]\d{3}[ .]\d{3})(?!\w|[./-]\w)"
)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)")
DATE = re.compile(r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})|\d{1,2}\.\d{1,2}\.(?:\d{4}|\d{2}))(?![\w/-]|\.\d)")
#: Dates with years of two digits are permuted among the days of these.
SHORT_FIRST, SHORT_LAST = dt.date(1950, 1, 1), dt.date(2049, 12, 31)
#: Months in English, German, French and Spanish.
MONTHS = (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
#: The language and number of each name; one that several languages have is the first one's.
MONTH_OF: dict[str, tuple[int, int]] = {}
for _language, _names in enumerate(MONTHS):
    for _number, _name in enumerate(_names.split(), 1):
        MONTH_OF.setdefault(_name, (_language, _number))
_ANY_MONTH = "|".join(sorted(MONTH_OF, key=len, reverse=True))
#: Day, month by name and year, or month, day and year.
NAMED_DATE = re.compile(rf"(?<![\w/.-])(?:(?P<d>\d{{1,2}})(?P<x>(?:\.|st|nd|rd|th|er)? (?:de )?)(?P<m>{_ANY_MONTH})(?P<y>,? (?:de )?\d{{4}})|(?P<n>{_ANY_MONTH})(?P<z> )(?P<e>\d{{1,2}})(?P<w>,? \d{{4}}))(?![\w/-])", re.IGNORECASE)


#: What spans call the kinds that stand for several patterns.
KIND_OF = {"international": "phone", "national": "phone", "named": "date"}


class Feistel:
    """A keyed permutation of [0, n) for any n, with its inverse: alternating rounds over a grid of at
    least n cells; a number that lands outside is permuted again until it lands inside."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _noise(self, tweak: str, i: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{tweak}|{i}|{x}".encode(), key=self.key, digest_size=24).digest())

    def _once(self, x: int, n: int, tweak: str, rounds: range, sign: int) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, a)
        for i in rounds:
            if i % 2 == 0:
                left = (left + sign * self._noise(tweak, i, right)) % b
            else:
                right = (right + sign * self._noise(tweak, i, left)) % a
        return left * a + right

    def _inside(self, x: int, n: int, tweak: str, inverse: bool) -> int:
        rounds, sign = (range(ROUNDS - 1, -1, -1), -1) if inverse else (range(ROUNDS), 1)
        while True:
            x = self._once(x, n, f"{tweak}|{n}", rounds, sign)
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str, inverse: bool = False, fits: Callable[[int], bool] = lambda x: True) -> int:
        """There by the network, on by a keyed step, and back by the network: so no number stays itself.
        fits: a further condition that x meets; the permutation is then one of the numbers that meet it."""
        if n < 2:
            return x
        step = 1 + self._noise(f"{tweak}|{n}|step", 0, 0) % (n - 1)
        while True:
            x = self._inside(x, n, tweak, False)
            x = self._inside((x - step if inverse else x + step) % n, n, tweak, True)
            if fits(x):
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it valid."""
    odd = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return str(-(odd + sum(int(d) for d in digits[-2::-2])) % 10)


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{98 - number % 97:02d}"


def _is_card(found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    return luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _is_iban(found: str) -> bool:
    plain = found.replace(" ", "")
    return iban_check(plain[:2], plain[4:]) == plain[2:4]


class Taken:
    """Spans of a text that hold a value already, in order; spans that overlap are one."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        lo, hi = bisect_right(self.ends, a), bisect_left(self.begins, b)
        if lo < hi:
            a, b = min(a, self.begins[lo]), max(b, self.ends[hi - 1])
        self.begins[lo:hi], self.ends[lo:hi] = [a], [b]

    def meets(self, a: int, b: int) -> bool:
        return bisect_right(self.ends, a) < bisect_left(self.begins, b)

    def within(self, a: int, b: int) -> Taken:
        """The spans that meet [a, b), counted from a."""
        lo, hi = bisect_right(self.ends, a), bisect_left(self.begins, b)
        return Taken((x - a, y - a) for x, y in zip(self.begins[lo:hi], self.ends[lo:hi]))


def _first(kind: str, pattern: re.Pattern, text: str, at: int, taken: Taken) -> tuple[int, int] | None:
    """Where the first card number or IBAN from `at` on stands, clear of what is taken. Of several that
    overlap it, one in the usual groups of cards counts most, then the longest, then the leftmost."""
    valid = _is_card if kind == "card" else _is_iban
    best, until = (), len(text)
    while (m := pattern.search(text, at)) and m.start() < until:
        for value in _shorter(kind, m[0]):
            end = m.start() + len(value)
            if not taken.meets(m.start(), end) and valid(value):
                until = until if best else end
                best = max(best, (bool(GROUPS.fullmatch(value)), len(value), -m.start()))
        at = m.start() + 1
    return (-best[2], best[1] - best[2]) if best else None


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    """Finds personal data in a text and replaces it by other values of the same format."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        self.feistel, self.inverse = Feistel(key), inverse
        self.cache: dict[tuple[str, str], str | None] = {}
        self.kinds = [
            ("iban", IBAN, self.iban), ("card", CARD, self.card), ("international", INTERNATIONAL, self.phone), ("phone", PHONE, self.phone),
            ("national", NATIONAL, self.national), ("ssn", SSN, self.ssn), ("ipv4", IPV4, self.ipv4), ("ipv6", IPV6, self.ipv6), ("date", DATE, self.date), ("named", NAMED_DATE, self.named_date),
        ]

    def _digits(self, kind: str, digits: str, fits: Callable[[str], bool] = lambda d: True) -> str:
        n = len(digits)
        return f"{self.feistel.permute(int(digits), 10**n, kind, self.inverse, lambda x: fits(f'{x:0{n}d}')):0{n}d}"

    def card(self, found: str, fits: Callable[[str], bool] = lambda v: True) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not _is_card(found):
            return None
        full = lambda d: _refill(found, d + luhn_digit(d))
        return full(self._digits("card", digits[:-1], lambda d: _is_card(full(d)) and fits(full(d))))

    def iban(self, found: str, fits: Callable[[str], bool] = lambda v: True) -> str | None:
        plain = found.replace(" ", "")
        country, rest = plain[:2], plain[4:]
        if not _is_iban(found):
            return None

        def full(new: str) -> str:
            filled = iter(country + iban_check(country, new) + new)
            return "".join(c if c == " " else next(filled) for c in found)

        return full(self.mixed("iban", rest, lambda new: fits(full(new))))

    def phone(self, found: str) -> str | None:
        country = re.match(r"\+\d{1,3}(?=[ .(-])", found)
        head = country[0] if country else ""
        rest = found[len(head) :]
        return head + _refill(rest, self._digits("phone", re.sub(r"\D", "", rest)))

    def national(self, found: str) -> str | None:
        """The trunk 0, or the first digit, stays."""
        head = re.match(r"\D*\d", found)[0]
        rest = found[len(head) :]
        return head + _refill(rest, self._digits("national", re.sub(r"\D", "", rest)))

    def ipv6(self, found: str) -> str | None:
        """Hexadecimal digits move, in one case; what has no decimal digit is left alone, and none becomes so."""
        digits, upper = re.sub(r"[^0-9A-Fa-f]", "", found), found != found.lower()
        if not re.search(r"\d", digits) or (upper and found != found.upper()):
            return None

        def at(x: int) -> str:
            it = iter(f"{x:0{len(digits)}{'X' if upper else 'x'}}")
            return "".join(c if c == ":" else next(it) for c in found)

        fits = lambda x: bool(re.search(r"\d", at(x))) and (not upper or at(x) != at(x).lower())
        return at(self.feistel.permute(int(digits, 16), 16 ** len(digits), "ipv6", self.inverse, fits))

    def named_date(self, found: str) -> str | None:
        """A date with its month by name: the new month has a name of the same language that no earlier one has, in the same case."""
        m = NAMED_DATE.fullmatch(found)
        name, day, year = m["m"] or m["n"], m["d"] or m["e"], m["y"] or m["w"]
        language, number = MONTH_OF[name.lower()]
        try:
            date = dt.date(int(year[-4:]), number, int(day))
        except ValueError:
            return None
        if not FIRST_DAY <= date <= LAST_DAY or name not in (name.lower(), name.upper(), name.capitalize()):
            return None
        of = lambda x: FIRST_DAY + dt.timedelta(x)
        named = lambda new: MONTHS[language].split()[new.month - 1]
        fits = lambda x: MONTH_OF[named(of(x))][0] == language and len(f"{of(x).day:0{1 if len(day) == 1 else 2}d}") == len(day)
        new = of(self.feistel.permute((date - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, f"named {language} {len(day)}", self.inverse, fits))
        text = named(new)
        text = text if name.islower() else text.upper() if name.isupper() else text.capitalize()
        number_ = f"{new.day:0{len(day)}d}"
        return f"{number_}{m['x']}{text}{year[:-4]}{new.year:04d}" if m["m"] else f"{text}{m['z']}{number_}{year[:-4]}{new.year:04d}"

    def ssn(self, found: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = found.replace("-", "")
        return _refill(found, self._digits("ssn", digits, valid)) if valid(digits) else None

    def ipv4(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255:
            return None
        x = self.feistel.permute(int.from_bytes(bytes(parts)), 1 << 32, "ipv4", self.inverse)
        return ".".join(map(str, x.to_bytes(4)))

    def date(self, found: str) -> str | None:
        """Year first, or day first where that is a day of the calendar, else month first. Years of two digits are those of SHORT_FIRST to SHORT_LAST."""
        texts, mark = re.split(r"\D", found), re.search(r"\D", found)[0]
        parts = [int(x) for x in texts]
        orders = ["ymd"] if len(texts[0]) == 4 else ["dmy", "mdy"] if mark == "/" else ["dmy"]
        short_year = "ymd" not in orders and len(texts[2]) == 2
        low, high = (SHORT_FIRST, SHORT_LAST) if short_year else (FIRST_DAY, LAST_DAY)
        for order in orders:
            p = dict(zip(order, parts))
            try:
                day = dt.date((1900 if p["y"] >= SHORT_FIRST.year - 1900 else 2000) + p["y"] if short_year else p["y"], p["m"], p["d"])
            except ValueError:
                continue
            if not low <= day <= high:
                return None
            short = {c for c, v in zip(order, texts) if len(v) == 1}

            def same(x: int) -> bool:
                """Month first and day first stay apart, or the way back would read the other one; what has one digit keeps one."""
                new = low + dt.timedelta(x)
                return (order != "mdy" or new.day > 12) and ("d" not in short or new.day < 10) and ("m" not in short or new.month < 10)

            kind = f"date {order}" + (" short" if short_year else "")
            new = low + dt.timedelta(self.feistel.permute((day - low).days, (high - low).days + 1, kind, self.inverse, same))
            year = f"{new.year % 100:02d}" if short_year else f"{new.year:04d}"
            values = {c: f"{v:0{1 if c in short else 2}d}" for c, v in (("m", new.month), ("d", new.day))} | {"y": year}
            return mark.join(values[c] for c in order)
        return None

    def mixed(self, kind: str, value: str, fits: Callable[[str], bool] = lambda v: True) -> str:
        """Letters and digits permuted together, each within its class; anything else stays."""
        classes = [CLASS_OF.get(c, "") for c in value]
        n, x = 1, 0
        for c, own in zip(value, classes):
            if own:
                n, x = n * len(own), x * len(own) + own.index(c)
        shape = "".join(own[0] if own else c for c, own in zip(value, classes))

        def at(x: int) -> str:
            out = list(value)
            for i in range(len(value) - 1, -1, -1):
                if own := classes[i]:
                    x, r = divmod(x, len(own))
                    out[i] = own[r]
            return "".join(out)

        return at(self.feistel.permute(x, n, f"{kind}|{shape}", self.inverse, lambda x: fits(at(x))))

    def local(self, found: str) -> str:
        cuts = [0, *range(len(found) % PIECE or PIECE, len(found), PIECE), len(found)]
        return "".join(self._new("email", found[a:b], lambda v: self.mixed("email", v)) for a, b in zip(cuts, cuts[1:]))

    def _checked(self, kind: str, pattern: re.Pattern, make: Callable[..., str | None], text: str, taken: Taken) -> Iterator[tuple[int, int, str]]:
        """Card numbers or IBANs with their pseudonyms. A pseudonym is one that is found in the same place,
        or the way back would read other digits beside it as part of the number."""
        at = 0
        while place := _first(kind, pattern, text, at, taken):
            a, b = place
            base = max(0, max(at, a - NEAR) - 1)
            start, before, behind = max(at, a - NEAR) - base, text[base:a], text[b : b + NEAR]
            near = taken.within(base, b + NEAR)
            fits = lambda v: _first(kind, pattern, before + v + behind, start, near) == (a - base, b - base)
            new = self._new(kind, text[a:b], make)
            yield a, b, new if fits(new) else make(text[a:b], fits)
            at = b

    def _new(self, kind: str, found: str, make: Callable[[str], str | None]) -> str | None:
        if (kind, found) not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[kind, found] = make(found)
        return self.cache[kind, found]

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with pseudonyms, and where they stand in it: kind, start, end (in characters)."""
        found: list[tuple[int, int, str, str]] = []
        taken = Taken()
        if "@" in text:
            for m in EMAIL.finditer(text):
                found.append((*m.span(), "email", self.local(m[0])))
                taken.add(m.start(), m.end(1))
        if re.search(r"\d", text):
            for kind, pattern, make in self.kinds:
                if kind in ("card", "iban"):
                    own = list(self._checked(kind, pattern, make, text, taken))
                    found += [(a, b, kind, new) for a, b, new in own]
                    for a, b, _ in own:
                        taken.add(a, b)
                    continue
                for m in pattern.finditer(text):
                    for value in _shorter(kind, m[0]):
                        end = m.start() + len(value)
                        if taken.meets(m.start(), end):
                            continue
                        if (new := self._new(kind, value, make)) is not None:
                            found.append((m.start(), end, KIND_OF.get(kind, kind), new))
                            taken.add(m.start(), end)
                            break
        out, spans, at, length = [], [], 0, 0
        for a, b, kind, new in sorted(found):
            out += [text[at:a], new]
            length += a - at
            spans.append({"kind": kind, "start": length, "end": length + len(new)})
            length += len(new)
            at = b
        return ("".join([*out, text[at:]]), spans) if found else (text, [])


def pseudonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, spans (array of kind, start, end in that text).

    Replaced are e-mail addresses (the whole part before the @), card numbers (valid by Luhn's rule, and
    valid again), IBANs (valid check digits, and valid again), phone numbers (with a + and a country code in
    any groups; without, in groups of 3, 3 and 4 digits, with a trunk 0 and an area code, in five pairs from 0 on, or in
    three groups of three from 6 to 9 on), US social security numbers, IPv4 and IPv6 addresses and calendar dates of the
    years 1900 to 2099, of two digits 1950 to 2049, with months as numbers or by name in four languages (others stay). Digits and letters move only within their format:
    Latin, Greek and Cyrillic letters within their alphabet and case; letters of other alphabets stay. A match
    that fails its check is tried shorter, up to each separator, and then from the next word on; numbers that
    fail it in every way are left alone. Under one key equal values get equal pseudonyms in every document,
    but for numbers beside digits or words with which their pseudonym would read as a longer one; `inverse`
    restores them, but may not where two numbers stand side by side with only a separator between them. A
    null text stays null, with no spans; repeated rows each have a row; an empty table gives none; other
    columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = Pseudonyms(key, inverse), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                made = [names.replace(t) if t is not None else (None, []) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t for t, _ in made], pa.string()), pa.array([s for _, s in made], kind)], names=["doc_id", "text", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>")
