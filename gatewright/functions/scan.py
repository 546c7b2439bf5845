"""JSON values anywhere in a text, in one pass from its end: no value is decoded twice, and nesting needs no recursion.

Brackets are taken from the last to the first. What an object or list holds starts behind its bracket, so its inner objects and lists
are known by then and are taken as they are; a bracket costs what stands on its own level. A bracket within a string is tried like any
other, so a place in the text belongs to two values at most that are not parts of one another.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

#: Values nested deeper count as none: JSON readers stop at some depth (Spark's at 1000 levels), encoders that recurse before.
MAX_DEPTH = 500
SPACE, NUMBER = re.compile(r"[ \t\n\r]*"), re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
#: A bracket that may start a value: what stands behind it may come first in an object or a list.
BRACKET, TOKEN = re.compile(r'\{(?=[ \t\n\r]*["}])|\[(?=[ \t\n\r]*[\]\[{"\-0-9tfnNI])'), re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)
#: Names that JSON text may have as values, those of numbers included.
NAMES = {"t": ("true", True), "f": ("false", False), "n": ("null", None), "N": ("NaN", float("nan")), "I": ("Infinity", float("inf")), "-": ("-Infinity", float("-inf"))}
Found = tuple[Any, int, int]


def depth_of(text: str) -> int:
    """How deep the brackets of a JSON text are nested, at most."""
    depth = most = 0
    if text.count("{") + text.count("[") > MAX_DEPTH:
        for m in TOKEN.finditer(text):
            c = m[0][0]
            depth += (c in "[{") - (c in "]}")
            most = max(most, depth)
    return most


def whole(text: str) -> tuple[bool, Any]:
    """Whether the whole text is one JSON value, and the value."""
    try:
        return depth_of(text) <= MAX_DEPTH, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


class Values:
    """The values that start at a text's places: value, end, and depth; none where none starts."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}
        for i in [m.start() for m in BRACKET.finditer(text)][::-1]:
            found = self._object(i) if text[i] == "{" else self._list(i)
            if found and found[2] <= MAX_DEPTH:
                self.known[i] = found

    def at(self, i: int) -> Found | None:
        c = self.text[i : i + 1]
        if c in ("{", "["):
            return self.known.get(i)
        if c == '"':
            try:
                return *scanstring(self.text, i + 1, True), 0
            except ValueError:
                return None
        number = NUMBER.match(self.text, i)
        if number:
            try:
                return (float(number[0]) if number[2] or number[3] else int(number[0])), number.end(), 0
            except ValueError:  # an integer of too many digits
                return None
        name, value = NAMES.get(c, ("", None))
        return (value, i + len(name), 0) if name and self.text.startswith(name, i) else None

    def _behind(self, i: int) -> int:
        return SPACE.match(self.text, i).end()

    def _list(self, i: int) -> Found | None:
        out, depth, p = [], 0, self._behind(i + 1)
        if self.text[p : p + 1] == "]":
            return out, p + 1, 1
        while found := self.at(p):
            out.append(found[0])
            depth, p = max(depth, found[2]), self._behind(found[1])
            if self.text[p : p + 1] == "]":
                return out, p + 1, depth + 1
            if self.text[p : p + 1] != ",":
                return None
            p = self._behind(p + 1)
        return None

    def _object(self, i: int) -> Found | None:
        out, depth, p = {}, 0, self._behind(i + 1)
        if self.text[p : p + 1] == "}":
            return out, p + 1, 1
        while self.text[p : p + 1] == '"' and (key := self.at(p)):
            p = self._behind(key[1])
            if self.text[p : p + 1] != ":" or not (found := self.at(self._behind(p + 1))):
                return None
            out[key[0]] = found[0]
            depth, p = max(depth, found[2]), self._behind(found[1])
            if self.text[p : p + 1] == "}":
                return out, p + 1, depth + 1
            if self.text[p : p + 1] != ",":
                return None
            p = self._behind(p + 1)
        return None
