"""Scalar text functions as columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space of any script (Unicode's White_Space).
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def py_strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.trim(c, F.lit(SPACE))


def clean(c: Column) -> Column:
    return py_strip(F.coalesce(c.cast("string"), F.lit("")))


def squeeze(c: Column) -> Column:
    """Lower-cased and stripped, inner white space one space."""
    return F.regexp_replace(F.lower(py_strip(c)), r"(?U)\s+", " ")


def step_name(n: Column) -> Column:
    """step_001 and so on; numbers of other than three digits at most are formatted one by one, which is slow."""
    return F.when(n.between(0, 999), F.concat(F.lit("step_"), F.lpad(n.cast("string"), 3, "0"))).otherwise(F.format_string("step_%03d", n))


def ascii_slug(c: Column, default: str = "quest") -> Column:
    """Lower-case letters and digits joined by underscores; letters beyond ASCII are dropped (see slug for accents)."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", default).otherwise(s)


#: A character of private use, which no slug keeps.
APART = "\ue000"


@cache
def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition has one ASCII letter or sign, and those that have more."""
    every = ((chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    found = {c: plain for c, plain in every if plain}
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def _ranges(chars: Iterable[str]) -> str:
    """Characters as what a regular expression has between brackets."""
    codes = sorted(map(ord, chars))
    firsts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    lasts = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts))


def slug(text: Column | str) -> Column:
    """As ascii_slug, with accents taken off first (compatibility decomposition, character by character: what is no ASCII is dropped anyway)."""
    one, more = _decomposed()
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    among = f"[[^\\x00-\\x7F]&&[{_ranges(more)}]]"
    pieces = F.split(F.regexp_replace(c, f"({among})", f"{APART}$1{APART}"), APART)
    known = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    spelt = F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(known, x), x)).otherwise(x)), "")
    plain = F.translate(F.when(c.rlike(among), spelt).otherwise(c), "".join(one), "".join(one.values()))
    return ascii_slug(F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c))


@F.pandas_udf(ArrayType(StringType()))
def slugs(lists):
    """slug of each text of a list."""
    import re
    import unicodedata

    def one(s: str | None) -> str:
        plain = unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "_", plain).strip("_") or "quest"

    return lists.map(lambda xs: None if xs is None else [one(x) for x in xs])
