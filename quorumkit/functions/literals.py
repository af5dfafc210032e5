"""A tolerant reader of values in generated text: JSON, Python literals, and sums and powers of whole numbers."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from typing import Any

#: Powers with more bits than this (4214 digits) are not worked out; their text stands for them.
MOST_BITS = 14_000
#: Brackets may be nested so deep.
DEEPEST = 200
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "\n": ""}


class Unreadable(ValueError):
    """No value stands here."""


class TooLarge(ArithmeticError):
    """A number of more than MOST_BITS bits."""


class Reader:
    """Reads values by descent. Single-quoted strings keep their backslashes if `plain`; double-quoted ones are JSON's."""

    def __init__(self, text: str, at: int = 0, plain: bool = False) -> None:
        self.text, self.at, self.plain, self.depth = text, at, plain, 0

    def _skip(self) -> str:
        """The next character that isn't blank, "" at the end."""
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def _take(self, mark: str) -> bool:
        self._skip()
        found = self.text.startswith(mark, self.at)
        self.at += len(mark) * found
        return found

    def whole(self) -> Any:
        """The one value that the text is."""
        value = self.value()
        if self._skip():
            raise Unreadable
        return value

    def value(self) -> Any:
        first = self._skip()
        if first in ("[", "(", "{") and first:
            self.depth += 1
            if self.depth > DEEPEST:
                raise Unreadable
            self.at += 1
            made = self._fields() if first == "{" else self._items("]" if first == "[" else ")")
            self.depth -= 1
            return made
        if first in ("'", '"') and first:
            return self._string(first)
        for word, value in _WORDS.items():
            if self.text.startswith(word, self.at) and not self.text[self.at + len(word) : self.at + len(word) + 1].isalnum():
                self.at += len(word)
                return value
        return self._number()

    def _items(self, close: str) -> list:
        out = []
        while not self._take(close):
            out.append(self.value())
            if not self._take(",") and self._skip() != close:
                raise Unreadable
        return out

    def _fields(self) -> dict:
        out = {}
        while not self._take("}"):
            key = self.value()
            if isinstance(key, (dict, list)) or not self._take(":"):
                raise Unreadable
            out[key if isinstance(key, str) else json.dumps(key)] = self.value()
            if not self._take(",") and self._skip() != "}":
                raise Unreadable
        return out

    def _string(self, quote: str) -> str:
        begin, at = self.at, self.at + 1
        while (c := self.text[at : at + 1]) != quote:
            if not c:
                raise Unreadable
            at += 2 if c == "\\" else 1
        self.at = at + 1
        inner = self.text[begin + 1 : at]
        if quote == '"':
            try:
                return json.loads(self.text[begin : self.at], strict=False)
            except ValueError:
                pass
        elif self.plain:
            return inner
        parts = iter(inner)
        return "".join(_ESCAPES.get(e := next(parts, ""), e) if c == "\\" else c for c in parts)

    def _number(self) -> Any:
        """A number, or whole numbers joined by + - * / % and **, worked out by rank."""
        begin = self.at
        try:
            return self._sum()
        except TooLarge:
            while self._skip() and self.text[self.at] in "+-*/%0123456789":
                self.at += 1
            return self.text[begin : self.at].strip()
        except ArithmeticError:
            raise Unreadable from None

    def _sum(self) -> float | int:
        left = self._product()
        while (mark := self._skip()) in ("+", "-") and mark:
            self.at += 1
            right = self._product()
            left = left + right if mark == "+" else left - right
        return left

    def _product(self) -> float | int:
        left = self._power()
        while (mark := self._skip()) in ("*", "/", "%") and mark:
            self.at += 1
            right = self._power()
            left = left * right if mark == "*" else left / right if mark == "/" else left % right
            _small(left)
        return left

    def _power(self) -> float | int:
        if self._take("-"):
            return -self._power()
        base = self._digits()
        if not self._take("**"):
            return base
        top = self._power()
        if isinstance(base, int) and abs(top) * max(1, base.bit_length()) > MOST_BITS:
            raise TooLarge
        made = base**top
        if isinstance(made, complex):
            raise Unreadable
        return _small(made)

    def _digits(self) -> float | int:
        self._skip()
        begin, text = self.at, self.text
        while self.at < len(text) and (text[self.at] in ".0123456789eE_" or (text[self.at] in "+-" and text[self.at - 1] in "eE" and self.at > begin)):
            self.at += 1
        found = text[begin : self.at]
        if not found[:1].isdecimal() and not found[:1] == ".":
            raise Unreadable
        if len(found) > MOST_BITS // 4:
            raise TooLarge
        try:
            return int(found) if found.replace("_", "").isdecimal() else float(found)
        except ValueError:
            raise Unreadable from None


def _small(x: float | int) -> float | int:
    if isinstance(x, int) and x.bit_length() > MOST_BITS:
        raise TooLarge
    return x


def _python(text: str) -> Any:
    found = ast.literal_eval(text)
    json.dumps(found)  # sets, bytes and the like are no values here
    return json.loads(json.dumps(found))


def _tolerant(text: str) -> Any:
    return Reader(text, plain=True).whole()


def first_of(text: str, *ways: Callable[[str], Any]) -> tuple | None:
    """The value that the first way to read all of the text gives, in a tuple, or None."""
    for way in ways:
        try:
            return (way(text),)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            continue
    return None


def strict(text: str) -> tuple | None:
    """JSON, with sums and powers in the places of numbers."""
    return first_of(text, json.loads, lambda t: Reader(t).whole() if "'" not in t else json.loads(t))


def tolerant(text: str) -> tuple | None:
    """JSON, a Python literal, or a mix of both."""
    return first_of(text, json.loads, _python, _tolerant)


def objects(text: str) -> Iterator[dict]:
    """The objects in a text, one after another, whatever stands between them."""
    at = text.find("{")
    while at >= 0:
        reader = Reader(text, at)
        try:
            found = reader.value()
            at = reader.at
            yield found
        except (ValueError, RecursionError):
            at += 1
        at = text.find("{", at)


def as_json(text: str) -> str | None:
    """A Python literal as JSON, JSON as it is, and a mix of both as JSON; None for anything else."""
    literal = first_of(text, lambda t: json.dumps(ast.literal_eval(t)))
    if literal:
        return literal[0]
    if first_of(text, json.loads):
        return text
    mixed = first_of(text, lambda t: json.dumps(_tolerant(t)))
    return mixed[0] if mixed else None
