"""JSON out of texts that hold more than JSON: prose around it, code fences, a cut end.

Scanning for the first place that decodes is beyond the built-in functions, so these are Arrow-batched functions of a
text column. All give JSON text, for try_parse_json; null where there is none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import scan

OPEN, CLOSE = re.compile(r"\A\s*```(?:json)?\s*", re.IGNORECASE), re.compile(r"\s*```\s*\Z")
MARKS = str.maketrans("", "", "﻿​")
ANY_START, LIST_OR_OBJECT = re.compile(r'[\[{"\-0-9tfn]'), re.compile(r"[\[{]")
WRAPPERS = ("result", "review", "semantic_review", "response")


def cleaned(text: str | None) -> str:
    return CLOSE.sub("", OPEN.sub("", (text or "").translate(MARKS))).strip()


def first_value(text: str | None, starts: re.Pattern[str] = ANY_START) -> tuple[bool, Any]:
    """Whether a JSON value was found, and the value: the whole text, or the first that starts at one of starts."""
    s = cleaned(text)
    found, value = scan.whole(s)
    return (True, value) if found else _first_of(scan.Values(s), starts)


def _first_of(values: scan.Values, starts: re.Pattern[str]) -> tuple[bool, Any]:
    for m in starts.finditer(values.text):
        if at := values.at(m.start()):
            return True, at[0]
    return False, None


def one_object(text: str | None) -> dict[str, Any] | None:
    """The object in a text: unwrapped at most three times from a key, a list of one, or a string that holds JSON."""
    found, x = first_value(text, LIST_OR_OBJECT)
    for _ in range(4 if found else 0):
        if isinstance(x, dict):
            inner = next((x[k] for k in WRAPPERS if isinstance(x.get(k), dict)), None)
            if inner is None:
                return x
            x = inner
        elif isinstance(x, list) and len(x) == 1:
            x = x[0]
        elif isinstance(x, str):
            x = first_value(x, LIST_OR_OBJECT)[1]
        else:
            return None
    return x if isinstance(x, dict) else None


def looks_like_artifact(x: Any) -> bool:
    return isinstance(x, dict) and isinstance(x.get("title"), str) and isinstance(x.get("objectives"), list) and any(isinstance(x.get(k), str) for k in ("summary", "quest_type"))


def scattered(values: scan.Values, wanted: Callable[[Any], bool] = looks_like_artifact) -> Iterator[dict[str, Any]]:
    """Whole objects anywhere in a text, also in one that is cut off; the same content under another quest_id counts once."""
    seen = set()
    for m in re.finditer("{", values.text):
        x = (values.at(m.start()) or (None,))[0]
        if wanted(x):
            mark = json.dumps({k: v for k, v in x.items() if k != "quest_id"}, sort_keys=True)
            if mark not in seen:
                seen.add(mark)
                yield x


def listed(text: str | None, recover: bool = True) -> list[dict[str, Any]]:
    """The artifacts of a response: objects of its list or of its key quests; if there are none, what is scattered in it."""
    s = cleaned(text)
    found, x = scan.whole(s)
    values = None if found else scan.Values(s)
    if values:
        x = _first_of(values, ANY_START)[1]
    rows = x.get("quests") if isinstance(x, dict) else x
    out = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return out or (list(scattered(values or scan.Values(s))) if recover else [])


def _dump(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False)


@F.pandas_udf(StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """The first JSON value of any kind."""
    return texts.map(lambda t: _dump(r[1]) if (r := first_value(t))[0] else None)


@F.pandas_udf(StringType())
def extract_object(texts: pd.Series) -> pd.Series:
    """The object, unwrapped."""
    return texts.map(lambda t: None if (x := one_object(t)) is None else _dump(x))


@F.pandas_udf(ArrayType(StringType()))
def extract_artifacts(texts: pd.Series) -> pd.Series:
    """All artifacts of a response."""
    return texts.map(lambda t: [_dump(x) for x in listed(t)])


@F.udtf(returnType="pos int, json string", useArrow=True)
class RecoverObjects:
    """A row for each artifact of a response; with recover false, only those of its list."""

    def eval(self, text: str, recover: bool) -> Iterator[tuple[int, str]]:
        for pos, x in enumerate(listed(text, recover)):
            yield pos, _dump(x)


def recovered(df: DataFrame, text: str, recover: bool = True) -> DataFrame:
    """df with pos and json: a row for each artifact of each text; texts without any have no row."""
    return df.lateralJoin(RecoverObjects(F.col(text).outer(), F.lit(recover)))


def register(spark: SparkSession) -> None:
    """Make recover_objects(text, recover) known to SQL: ... FROM t, LATERAL recover_objects(t.response, true)."""
    spark.udtf.register("recover_objects", RecoverObjects)
