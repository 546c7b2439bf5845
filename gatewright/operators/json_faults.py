"""Fault injection into JSON artifacts, and scores of what gates detect, with valid artifacts as controls.

A mutation replaces keys of the artifact's VARIANT; nothing else of it is touched. Faults that need objectives are made of artifacts that
have some; those that need two are made of all these, and change nothing where there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..sources.artifacts import at, elements, is_object
from . import json_gates
from .content import GENERIC as PATTERNS
from .content import WEAK, says
from .faults import scores
from .schema_gate import count_of

#: Fault types and the code that each must raise; what mutations write.
FAULTS = {
    "missing_required_field": "SCHEMA_VIOLATION",
    "unknown_target": "INVALID_OR_IMPLICIT_TARGET",
    "wrong_giver_type": "INVALID_QUEST_GIVER_TYPE",
    "duplicate_step_id": "DUPLICATE_STEP_ID",
    "missing_dependency": "MISSING_STEP_DEPENDENCY",
    "cyclic_dependency": "CYCLIC_OBJECTIVE_DEPENDENCY",
    "generic_completion": "GENERIC_COMPLETION_CONDITION",
}
WRONG_GIVER, NO_ENTITY, NO_STEP = "item_mapa_antigo", "entity_not_in_world", "step_inexistente"
GENERIC = "Completar todos os objetivos da quest."
#: The gates in their order, and the one that raises each fault's code.
GATES = ("schema", "referential", "graph", "content")
GATES_OF = {"missing_required_field": "schema", "unknown_target": "referential", "wrong_giver_type": "referential", "duplicate_step_id": "referential", "missing_dependency": "graph", "cyclic_dependency": "graph", "generic_completion": "content"}
NEED_STEPS = ("unknown_target", "duplicate_step_id", "missing_dependency", "cyclic_dependency")


def with_key(v: Column, key: str, value: Column | None) -> Column:
    """The object with a key's value replaced, or without the key."""
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != key)
    return F.to_variant_object(rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), value)))


def _text(c: Column | str) -> Column:
    return (F.lit(c) if isinstance(c, str) else c).cast("variant")


def _list(c: Column) -> Column:
    return F.to_variant_object(F.array(c))


def mutants(artifacts: DataFrame, wrong_giver: str = WRONG_GIVER) -> DataFrame:
    """quest_id (of the mutant: '<id>::<fault>'), v, origin, fault_type, expected_code of keyed artifacts."""
    v, steps = F.col("v"), elements(at(F.col("v"), "objectives"))
    name = lambda i: F.coalesce(at(F.get(steps, F.lit(i)), "step_id").cast("string"), F.lit(f"step_{i + 1:03d}"))
    two = F.size(steps) > 1

    def put(i: int, key: str, value: Column) -> Column:
        return F.transform(steps, lambda s, n: F.when(n == i, with_key(s, key, value)).otherwise(s))

    def steps_as(xs: Column) -> Column:
        return with_key(v, "objectives", F.to_variant_object(xs))

    ring = F.transform(steps, lambda s, n: F.when(n == 0, with_key(s, "depends_on", _list(name(1)))).when(n == 1, with_key(s, "depends_on", _list(name(0)))).otherwise(s))
    made = {
        "missing_required_field": with_key(v, "title", None),
        "unknown_target": steps_as(put(0, "target", _text(NO_ENTITY))),
        "wrong_giver_type": with_key(v, "giver_npc", _text(wrong_giver)),
        "duplicate_step_id": F.when(two, steps_as(put(1, "step_id", _text(name(0))))).otherwise(v),
        "missing_dependency": steps_as(put(0, "depends_on", _list(F.lit(NO_STEP)))),
        "cyclic_dependency": F.when(two, steps_as(ring)).otherwise(v),
        "generic_completion": with_key(v, "completion_conditions", _list(F.lit(GENERIC))),
    }
    fault = lambda f: F.struct(F.lit(f).alias("fault_type"), F.lit(FAULTS[f]).alias("expected_code"), made[f].alias("m"))
    each = F.array_compact(F.array(*[F.when(F.size(steps) > 0, fault(f)) if f in NEED_STEPS else fault(f) for f in FAULTS]))
    rows = artifacts.select("quest_id", F.explode(each).alias("f"))
    return rows.select(F.concat_ws("::", "quest_id", "f.fault_type").alias("quest_id"), F.col("f.m").alias("v"), F.col("quest_id").alias("origin"), "f.fault_type", "f.expected_code")


def evaluate(made: DataFrame, issues: DataFrame, validators: tuple[str, ...], controls: DataFrame, control_issues: DataFrame) -> DataFrame:
    """scope, name, tp, fp, fn, tn and scores: for each validator, each fault type (detected by any) and all validators together.

    made: mutants (quest_id, fault_type, expected_code); controls: valid artifacts (quest_id); issues of both: quest_id,
    validator, code. Any issue of a control, warnings included, is a false positive."""
    hit = issues.join(made.select("quest_id", F.col("expected_code").alias("code")), ["quest_id", "code"], "left_semi").select("quest_id", "validator").distinct()
    flagged = control_issues.select("quest_id", "validator").distinct()

    def judged(df: DataFrame, control: bool, found: DataFrame) -> DataFrame:
        """A row for each artifact and validator, and one ('') for all of them."""
        by = found.groupBy("quest_id").agg(F.collect_set("validator").alias("by"))
        fault = F.lit(None).cast("string").alias("fault_type") if control else F.col("fault_type")
        each = F.explode(F.array(*map(F.lit, (*validators, "")))).alias("validator")
        rows = df.select("quest_id", fault).join(by, "quest_id", "left").select("quest_id", "fault_type", "by", each)
        hits = F.when(F.col("validator") == "", F.size("by") > 0).otherwise(F.array_contains("by", F.col("validator")))
        return rows.select("fault_type", "validator", F.lit(control).alias("control"), F.coalesce(hits, F.lit(False)).alias("hit"))

    return outcomes(judged(made, False, hit).unionByName(judged(controls, True, flagged)).withColumn("n", F.lit(1).cast("long")))


def outcomes(rows: DataFrame) -> DataFrame:
    """See evaluate; rows: fault_type (null for controls), validator ('' for all of them), control, hit, and n: how many there are of these."""
    any_, hits, control = F.col("validator") == "", F.col("hit"), F.col("control")
    outcome = {"tp": ~control & hits, "fn": ~control & ~hits, "fp": control & hits, "tn": control & ~hits}
    counts = [F.sum(F.when(c & ok, F.col("n")).otherwise(0)).alias(f"{kind}_{n}") for n, c in outcome.items() for kind, ok in (("each", ~any_), ("any", any_))]
    # Rows are kept apart by a copy of the columns that are grouped, for the grouped ones are null where a set has not got them.
    keyed = rows.withColumns({"gate": F.col("validator"), "fault": F.col("fault_type")})
    sums = keyed.groupingSets([[F.col("gate")], [F.col("fault")], []], F.col("gate"), F.col("fault")).agg(F.grouping_id().alias("g"), *counts)
    level = F.when(F.col("g") == 1, "validator").when(F.col("g") == 2, "fault").otherwise("architecture")
    name = F.when(F.col("g") == 1, F.col("gate")).when(F.col("g") == 2, F.col("fault")).otherwise("all")
    picked = [F.when(F.col("g") == 1, F.col(f"each_{n}")).otherwise(F.col(f"any_{n}")).alias(n) for n in outcome]
    told = sums.select(level.alias("scope"), name.alias("name"), *picked).where("name is not null and name != ''")
    return told.select("scope", "name", "tp", "fp", "fn", "tn", *scores(*map(F.col, ("tp", "fp", "fn", "tn"))))


def detected(artifacts: DataFrame, entity: DataFrame, schema: dict, compat: dict[str, tuple[str, ...]], wrong_giver: str = WRONG_GIVER) -> DataFrame:
    """evaluate of all mutants and of the artifacts as controls, with the four gates (json_gates).

    Mutations are made in their artifact's row, to the fields that the gate of the expected code reads, and judged there for that code. Only
    references go to the catalog, and only those of artifacts that are not decided without them."""
    wanted, v, o = json_gates.Wanted(compat), F.col("v"), F.col("o")
    known = {x: [r.entity_type for r in entity.where(F.col("entity_id") == x).collect()] for x in (wrong_giver.strip(SPACE), NO_ENTITY)}
    giver = [t for t in known[wrong_giver.strip(SPACE)] if t is not None and t not in wanted.CORE["giver_npc"]]
    no_entity = not known[NO_ENTITY] or None in known[NO_ENTITY]

    rows = json_gates.with_edges(json_gates.read(artifacts))
    step = lambda i: F.get(F.filter(o, lambda s: s["pos"] == i), F.lit(0))
    name = lambda i: F.coalesce(step(i)["own"], F.lit(f"step_{i + 1:03d}"))
    first, two = F.coalesce(step(0)["pos"] == 0, F.lit(False)), F.size("raw") > 1

    def put(s: Column, field: str, value: Column) -> Column:
        return s.withField(field, value)

    def ring(s: Column) -> Column:
        other = F.when(s["pos"] == 0, F.array("name1")).when(s["pos"] == 1, F.array("name0")).otherwise(s["deps"])
        return put(s, "deps", other)

    rows = rows.withColumns({"name0": name(0), "name1": name(1), "first": first})
    rows = rows.withColumn("ring", F.when(two, F.transform(o, ring)).otherwise(o))
    twice = json_gates.own_names(F.transform(o, lambda s: F.when(two & (s["pos"] == 1), put(s, "own", F.col("name0"))).otherwise(s)))
    gone = json_gates.stated(F.transform(o, lambda s: F.when(s["pos"] == 0, put(s, "deps", F.array(F.lit(NO_STEP)))).otherwise(s)))
    unlisted = lambda deps: F.size(F.array_except(deps, F.col("names"))) > 0
    issues = lambda x: F.coalesce(F.get(F.transform(F.array(x), lambda y: F.when(y.isNotNull(), count_of(y, schema)).otherwise(0)), F.lit(0)), F.lit(0)) > 0
    object_, some = is_object(v), F.size("raw") > 0
    rows = json_gates.settled(rows, around=json_gates.edges(F.col("ring"))).select(
        "quest_id", json_gates.references(wanted).alias("refs"), "edges", "around", some.alias("some"),
        issues(with_key(v, "title", None)).alias("missing_required_field"), F.lit(no_entity).__and__(F.col("first")).alias("unknown_target"), (object_ & F.lit(bool(giver))).alias("wrong_giver_type"),
        (F.size(F.array_distinct(twice)) < F.size(twice)).alias("duplicate_step_id"), unlisted(gone).alias("missing_dependency"), (object_ & says(F.lit(GENERIC), PATTERNS)).alias("generic_completion"),
        issues(v).alias("schema"), (F.size(F.array_distinct("names")) < F.size("names")).alias("referential"), (unlisted(F.col("stated")) | (json_gates.odd_lists() > 0)).alias("graph"), (json_gates.roots(o, F.col("edges")) > 1).alias("rooted"),
        (json_gates.hits(F.col("x.completion_conditions"), PATTERNS) + json_gates.hits(F.col("x.preconditions"), WEAK) + json_gates.unclear() > 0).alias("content"),
    )
    rows = json_gates.with_cyclic(rows, cyclic="edges", cyclic_dependency="around")
    rows = rows.withColumn("graph", F.col("graph") | F.col("cyclic") | F.col("rooted"))
    bits = ("some", *FAULTS, *GATES)
    bit = {k: 1 << i for i, k in enumerate(bits)}
    told = lambda k: F.col(k) & F.col("some") if k in NEED_STEPS else F.col(k)
    alone = reduce(Column.__add__, [F.when(F.coalesce(told(k), F.lit(False)), b).otherwise(0) for k, b in bit.items()])
    decided = F.col("referential") & (F.col("unknown_target") | ~F.col("some"))
    rows = rows.select("quest_id", F.when(decided, F.slice("refs", 1, 0)).otherwise(F.col("refs")).alias("refs"), alone.alias("alone"))

    known_refs = json_gates.looked_up(rows, wanted, entity)
    lost = F.col("want").isNotNull() & F.col("type").isNull()
    wrong = lost | F.coalesce(F.col("want").isNotNull() & wanted.unfit(F.col("want"), F.col("type")), F.lit(False))
    own = known_refs.select("quest_id", "alone", F.when(lost & (F.col("at") > 0), bit["unknown_target"] + bit["referential"]).when(wrong, bit["referential"]).alias("more")).where("alone is not null or more is not null")
    by = own.groupBy("quest_id").agg(F.count("alone").alias("n"), F.count_if(F.col("alone").bitwiseAND(bit["some"]) > 0).alias("n_some"), F.bit_or(F.coalesce("alone", "more")).alias("bits"))
    # A mutant without a name cannot be told to be caught.
    hits = sum(bit[k] for k in FAULTS)
    small = by.groupBy(F.when(F.col("quest_id").isNull(), F.col("bits").bitwiseAND(~hits)).otherwise(F.col("bits")).alias("bits")).agg(F.sum("n").alias("n"), F.sum("n_some").alias("n_some"))
    row = lambda fault, gate, control, hit, n: F.struct(F.lit(fault).cast("string").alias("fault_type"), F.lit(gate).alias("validator"), F.lit(control).alias("control"), hit.alias("hit"), F.col(n).alias("n"))
    is_ = lambda k: F.col("bits").bitwiseAND(bit[k]) > 0
    made = [row(f, g, False, is_(f) if g in ("", GATES_OF[f]) else F.lit(False), "n_some" if f in NEED_STEPS else "n") for f in FAULTS for g in (*GATES, "")]
    controls = [row(None, g, True, is_(g) if g else reduce(Column.__or__, map(is_, GATES)), "n") for g in (*GATES, "")]
    return outcomes(small.select(F.inline(F.array(*made, *controls))))
