"""Kinds of personal data by country: what is found, that the format stays, and that the key brings it back."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quorumkit.llm import pii

KEY = b"k" * 16
THERE, BACK = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, True)
FOUND = {
    "phone": ["0171 2345678", "030 / 1234567", "06 12 34 56 78", "06.12.34.56.78", "(030) 12345678", "612 345 678", "07700 900123", "020 7946 0958", "0171-2345678", "030/1234567", "(0171) 2345678-12"],
    "date": ["12.03.24", "03/04/99", "2001/03/05", "31/12/99", "12/31/99", "1.2.03", "5 March 2001", "March 5, 2001", "5. März 2001", "1er août 1999", "5 de marzo de 2001", "12 APRIL 2003", "29 February 2000", "3 diciembre 1950"],
    "ipv6": ["2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "FE80::1", "1::2"],
    "iban": ["de89370400440532013000", "gb82 west 1234 5698 7654 32"],
    "email": ["hans@münchen.de", "анна@пример.рф"],
}
LEFT = ["v1.2.34", "10.5.2", "1.2.3.4.5", "add::face", "12:30:45", "version 0123", "5 apples 2001", "31 February 2001", "5 march 1492", "12.13.24", "99/99/99", "2001/13/05", "0 123", "a::b", "Fe80::1", "1:2:3"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, values in FOUND.items() for v in values])
@pytest.mark.parametrize("frame", ["{}", "see {} now", "({})", "{}, or"])
def test_found_and_brought_back(kind, value, frame):
    if frame == "({})" and value.startswith("("):
        frame = "[{}]"
    text = frame.format(value)
    new, spans = THERE.replace(text)
    assert [s["kind"] for s in spans] == [kind] and new != text and BACK.replace(new)[0] == text
    shape = lambda t: re.sub(r"\d", "0", t)
    if kind == "phone" or (kind == "date" and not re.search("[A-Za-z]", value)):
        assert shape(new) == shape(text)


@pytest.mark.parametrize("value", LEFT)
def test_left_alone(value):
    assert THERE.replace(f"x {value} y") == (f"x {value} y", [])


DAYS = st.dates(dt.date(1950, 1, 1), dt.date(2049, 12, 31))


def shown(day: dt.date, style: int, pad: bool) -> str:
    d, m = (f"{day.day:02d}", f"{day.month:02d}") if pad else (str(day.day), str(day.month))
    name = pii.MONTHS[style % 4].split()[day.month - 1]
    return [f"{d}.{m}.{day.year % 100:02d}", f"{d}/{m}/{day.year % 100:02d}", f"{day.year}/{day.month:02d}/{day.day:02d}", f"{d} {name} {day.year}", f"{name.capitalize()} {d}, {day.year}"][style % 5]


@settings(max_examples=150, deadline=None)
@given(DAYS, DAYS, st.integers(0, 19), st.booleans())
def test_dates_stay_dates(one, other, style, pad):
    """Equal dates stay equal, different ones different; a date is a date after it, and comes back."""
    texts = [f"on {shown(day, style, pad)} or" for day in (one, other)]
    new = [THERE.replace(t)[0] for t in texts]
    assert all(a != b for a, b in zip(texts, new)) and [BACK.replace(t)[0] for t in new] == texts
    assert (new[0] == new[1]) == (texts[0] == texts[1])
    assert all(len(THERE.replace(t)[1]) == 1 for t in new)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("0123456789 ./-()+:abcdefmayMärz,@"), max_size=60))
def test_any_text_keeps_what_is_no_data(text):
    """Outside of spans nothing changes; the number of spans is what was found."""
    new, spans = THERE.replace(text)
    out, at, cut = [], 0, []
    for s in spans:
        out.append(new[at : s["start"]])
        cut.append(new[s["start"] : s["end"]])
        at = s["end"]
    out.append(new[at:])
    rest = text
    for piece in out:
        assert piece in rest
        rest = rest[rest.index(piece) + len(piece) :]
    assert all(cut)
