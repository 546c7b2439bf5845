"""A JSON Schema as one column expression over a VARIANT: a gate without Python in the rows' path.

Keywords: type, enum, const, required, properties, additionalProperties (false), items, minItems, maxItems, uniqueItems,
minLength, maxLength, pattern, minimum, maximum. Others raise an error when the gate is built, so that none is skipped in
silence. A keyword that does not apply to a value's type is satisfied. Each failing keyword is one issue, each missing key
one more; issues are numbered by the parts of their paths as strings. Numbers compare by value; lists and objects in
enum and uniqueItems by their JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import is_object, is_string, items_of, kind, members

NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
KEYWORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum"}
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE")
NONE = "cast(array() as array<struct<parts: array<string>, keyword: string, detail: string>>)"


def _issue(parts: Column, keyword: str, detail: Column) -> Column:
    return F.struct(parts.alias("parts"), F.lit(keyword).alias("keyword"), F.coalesce(detail, F.lit("")).alias("detail"))


def _is(v: Column, wanted: str) -> Column:
    if wanted == "object":
        return is_object(v)
    if wanted == "array":
        return items_of(v).isNotNull()
    if wanted == "string":
        return is_string(v)
    if wanted in ("integer", "number"):
        x, number = F.try_variant_get(v, "$", "double"), kind(v).isin(*NUMBERS)
        return number & (x == F.floor(x)) if wanted == "integer" else number
    return F.schema_of_variant(v) == {"boolean": "BOOLEAN", "null": "VOID"}[wanted]


def _token(v: Column) -> Column:
    """A value as text that equal values share: numbers by value, apart from strings and booleans."""
    return F.when(kind(v).isin(*NUMBERS), F.concat(F.lit("number "), F.try_variant_get(v, "$", "double").cast("string"))).when(kind(v) == "STRING", F.concat(F.lit("string "), F.try_variant_get(v, "$", "string"))).otherwise(F.to_json(v))


def _constant(x: Any) -> str:
    if isinstance(x, str):
        return f"string {x}"
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _one_of(v: Column, values: list[Any]) -> Column:
    if all(isinstance(x, str) for x in values):
        return is_string(v) & F.try_variant_get(v, "$", "string").isin(values)
    plain = [x for x in values if not isinstance(x, (int, float)) or isinstance(x, bool)]
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    found = _token(v).isin([_constant(x) for x in plain]) if plain else F.lit(False)
    return found | (_is(v, "number") & F.try_variant_get(v, "$", "double").isin(numbers)) if numbers else found


def _with(x: Column, issues: Callable[[Column], Column]) -> Column:
    """issues(x), with x evaluated once however often it is named in there."""
    return F.flatten(F.transform(F.array(x), issues))


def _told(tests: list[tuple[Column, str, Column]], parts: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), _issue(parts, k, shown)) for bad, k, shown in tests]))


def _list_issues(xs: Column, schema: dict[str, Any], parts: Column) -> Column:
    """Issues of a list's keywords; xs: its elements, null if the value is no list."""
    tests = _list_tests(xs, schema)
    found = [_told(tests, parts)] if tests else []
    if "items" in schema:
        each = F.flatten(F.transform(xs, lambda y, i: issues_of(y, schema["items"], F.array_append(parts, i.cast("string")))))
        found.append(F.coalesce(each, F.expr(NONE)))
    return F.concat(*found)


def _list_tests(xs: Column, schema: dict[str, Any]) -> list[tuple[Column, str, Column]]:
    tests, n = [], F.size(xs)
    if "minItems" in schema:
        tests.append((xs.isNotNull() & (n < schema["minItems"]), "minItems", n.cast("string")))
    if "maxItems" in schema:
        tests.append((xs.isNotNull() & (n > schema["maxItems"]), "maxItems", n.cast("string")))
    if schema.get("uniqueItems"):
        tokens = F.transform(xs, _token)
        tests.append((xs.isNotNull() & (F.size(F.array_distinct(tokens)) < F.size(tokens)), "uniqueItems", F.lit("")))
    return tests


def _object_issues(m: Column, schema: dict[str, Any], parts: Column) -> Column:
    """Issues of an object's keywords; m: its members by key, null if the value is no object."""
    keys, known, found = F.coalesce(F.map_keys(m), F.expr("cast(array() as array<string>)")), schema.get("properties", {}), []
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>")))
        found.append(_told([(F.size(extra) > 0, "additionalProperties", F.array_join(extra, ", "))], parts))
    if schema.get("required"):
        lacking = F.array_except(F.array(*map(F.lit, schema["required"])), keys)
        found.append(F.when(m.isNotNull(), F.transform(lacking, lambda k: _issue(parts, "required", k))).otherwise(F.expr(NONE)))
    for name, sub in known.items():
        inner = partial(issues_of, schema=sub, parts=F.array_append(parts, F.lit(name)))
        found.append(F.when(F.array_contains(keys, name), _with(F.try_element_at(m, F.lit(name)), lambda x: inner(x))).otherwise(F.expr(NONE)))  # noqa: B023
    return F.concat(*found)


def _check(schema: dict[str, Any]) -> None:
    if unknown := set(schema) - KEYWORDS - NOTES:
        raise ValueError(f"keywords that the schema gate does not know: {', '.join(sorted(unknown))}")
    if not isinstance(schema.get("additionalProperties", False), bool):
        raise ValueError("additionalProperties can be true or false")


def issues_of(v: Column, schema: dict[str, Any], parts: Column | None = None) -> Column:
    """array<struct<parts, keyword, detail>> of the value v, which is there."""
    parts = F.expr("cast(array() as array<string>)") if parts is None else parts
    _check(schema)
    tests = _own_tests(v, schema)
    found = [_told(tests, parts)] if tests else []
    if {"minItems", "maxItems", "items"} & set(schema) or schema.get("uniqueItems"):
        found.append(_with(items_of(v), lambda xs: _list_issues(xs, schema, parts)))
    if schema.get("properties") or schema.get("required") or schema.get("additionalProperties") is False:
        found.append(_with(members(v), lambda m: _object_issues(m, schema, parts)))
    return F.concat(*found) if found else F.expr(NONE)


def _own_tests(v: Column, schema: dict[str, Any]) -> list[tuple[Column, str, Column]]:
    """Tests of keywords that look at the value alone: whether it fails, the keyword, and what is shown of the value."""
    tests: list[tuple[Column, str, Column]] = []
    string, number = _is(v, "string"), _is(v, "number")
    s, x = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for t in wanted:
            fits = fits | _is(v, t)
        tests.append((~fits, "type", kind(v)))
    if "enum" in schema:
        tests.append((~_one_of(v, schema["enum"]), "enum", F.to_json(v)))
    if "const" in schema:
        tests.append((~_one_of(v, [schema["const"]]), "const", F.to_json(v)))
    for key, guard, bad, shown in (
        ("minLength", string, lambda n: F.length(s) < n, s),
        ("maxLength", string, lambda n: F.length(s) > n, s),
        ("pattern", string, lambda p: ~s.rlike(p), s),
        ("minimum", number, lambda n: x < n, x.cast("string")),
        ("maximum", number, lambda n: x > n, x.cast("string")),
    ):
        if key in schema:
            tests.append((guard & bad(schema[key]), key, shown))
    return tests


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often it is named in there."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(xs: list[Column]) -> Column:
    return reduce(Column.__add__, xs) if xs else F.lit(0)


def _fields(v: Column, types: dict[str, str]) -> Column:
    """An object's members of these names, read in one go as these types; null if v is no object."""
    return F.try_variant_get(v, "$", _struct(types))


def _struct(types: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{n.replace('`', '``')}`: {t}" for n, t in types.items()) + ">"


def _plain(schema: dict[str, Any]) -> bool:
    """Whether all keywords are about strings: of such values no variant is made, for a member that reads as binary is a string."""
    return set(schema) <= {"type", "enum", "minLength", "maxLength", "pattern"} | NOTES and schema.get("type", "string") == "string" and all(isinstance(x, str) for x in schema.get("enum", ()))


def _text_issues(text: Column, schema: dict[str, Any]) -> Column:
    s = text.cast("string")
    tests = {"enum": lambda xs: ~s.isin(xs), "minLength": lambda n: F.length(s) < n, "maxLength": lambda n: F.length(s) > n, "pattern": lambda p: ~s.rlike(p)}
    return _sum([F.when(tests[k](schema[k]), 1).otherwise(0) for k in tests if k in schema])


def _items_count(v: Column, schema: dict[str, Any]) -> Column:
    """Issues of a list's elements. Objects whose members are all there, and strings, are read as texts; lists with others as variants."""
    slow = F.coalesce(F.aggregate(F.transform(items_of(v), lambda x: count_of(x, schema)), F.lit(0), lambda n, x: n + x), F.lit(0))
    known = schema.get("properties", {})
    names = sorted({*known, *schema.get("required", ())})
    if not names or len({n.lower() for n in names}) < len(names) or not set(schema) <= {"type", "required", "properties"} | NOTES or schema.get("type", "object") != "object" or not all(map(_plain, known.values())):
        return slow
    there = lambda s: reduce(Column.__and__, [s.getField(n).isNotNull() for n in names])
    each = lambda n, s: n + _sum([_text_issues(s.getField(k), sub) for k, sub in known.items()])
    read = F.try_variant_get(v, "$", f"array<{_struct(dict.fromkeys(names, 'binary'))}>")
    return _let(read, lambda xs: F.when(xs.isNull(), 0).when(F.forall(xs, lambda s: s.isNotNull() & there(s)), F.aggregate(xs, F.lit(0), each)).otherwise(slow))


def count_of(v: Column, schema: dict[str, Any]) -> Column:
    """How many issues issues_of has of v (an int), without the issues: no paths, no details, no lists of them."""
    _check(schema)
    bad = lambda c: F.when(F.coalesce(c, F.lit(True)), 1).otherwise(0)
    inner = lambda sub: lambda x: count_of(x, sub)
    found = [bad(c) for c, _, _ in _own_tests(v, schema)]
    if {"minItems", "maxItems"} & set(schema) or schema.get("uniqueItems"):
        xs = items_of(v) if schema.get("uniqueItems") else F.try_variant_get(v, "$", "array<struct<>>")
        found.append(_let(xs, lambda xs: _sum([bad(c) for c, _, _ in _list_tests(xs, schema)])))
    if "items" in schema:
        found.append(_items_count(v, schema["items"]))
    known, needed = schema.get("properties", {}), set(schema.get("required", ()))
    if known or needed:
        names = sorted({*known, *needed})
        one = lambda k: _fields(v, {k: "variant"}).getField(k)
        texts = [k for k in names if _plain(known.get(k, {}))]
        if len({n.lower() for n in texts}) < len(texts):
            texts = []

        def held(m: Column) -> Column:
            text = lambda k: m.getField(k).isNotNull() if k in texts else F.lit(False)
            parts = [F.when(text(k), 0).when(is_object(v) & one(k).isNull(), 1).otherwise(0) for k in sorted(needed)]
            for k, sub in known.items():
                other = F.when(one(k).isNotNull(), _let(one(k), inner(sub))).otherwise(0)
                parts.append(F.when(text(k), _text_issues(m.getField(k), sub)).otherwise(other) if k in texts else other)
            return _sum(parts)

        found.append(_let(_fields(v, dict.fromkeys(texts, "binary")), held))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,struct<>>"))
        found.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))) > 0, 1).otherwise(0))
    return _sum(found)


def schema_gate(artifacts: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """Issue rows, with seq (their order within an artifact), for artifacts (quest_id, v). A null v has no issues."""
    placed = F.transform(issues_of(F.col("v"), schema), lambda i, n: F.struct(i["parts"].alias("parts"), n.alias("n"), i["keyword"].alias("keyword"), i["detail"].alias("detail")))
    rows = artifacts.where("v is not null").select("quest_id", F.posexplode(F.array_sort(placed)).alias("seq", "i"))
    return rows.select("quest_id", F.lit("schema").alias("validator"), F.lit("SCHEMA_VIOLATION").alias("code"), F.lit("error").alias("severity"), F.array_join("i.parts", ".").alias("path"), F.col("i.keyword").alias("keyword"), F.col("i.detail").alias("detail"), "seq")
