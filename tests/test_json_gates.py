"""The gates over JSON artifacts in one pass, where what they say is counted, against the gates that give issue rows."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.operators import experiments, json_faults, json_gates
from gatewright.operators.schema_gate import count_of, issues_of
from gatewright.plans import catalog, front_catalog, json_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
SCHEMA = {
    "type": "object", "required": ["quest_id", "title", "no.such"], "additionalProperties": False,
    "properties": {
        "quest_id": {"type": "string", "pattern": "^a"}, "title": {"minLength": 3, "enum": ["long", "no", "ten"]}, "Title": {"type": "integer", "minimum": 2}, "giver_npc": {"type": "string"}, "start_location": {"type": ["string", "null"]},
        "objectives": {"type": "array", "minItems": 2, "maxItems": 3, "items": {"type": "object", "required": ["step_id"], "properties": {"action": {"enum": ["talk", "use"]}, "success_condition": {"type": "string", "minLength": 12}}}},
        "completion_conditions": {"items": {"type": "string", "maxLength": 20}, "uniqueItems": True}, "preconditions": {}, "rewards": {"items": {"properties": {"value": {"type": "string"}}, "additionalProperties": False}},
    },
}
COMPAT = {"Talk": ("npc",), "use": ("item",), "none": ()}
LONG = [{"step_id": f"s{i}", "depends_on": [f"s{i - 1}", f"s{i - 1}"] if i else [], "target": "key", "action": "use"} for i in range(300)]
STEPS = [
    [], "no", None, [1], [{}], [None, {"depends_on": ["step_001"]}], [{"step_id": "a", "depends_on": "b"}, {"step_id": "a"}, {"step_id": "", "depends_on": [None, 3, "zz"]}], [{"step_id": 7, "depends_on": ["7"]}, {"step_id": "7", "depends_on": None}],
    [{"step_id": "a", "depends_on": ["b"], "action": " TALK ", "target": " ana "}, {"step_id": "b", "depends_on": ["c"], "action": "use", "target": "ana"}, {"step_id": "c", "depends_on": ["a"], "action": 5, "target": "ghost"}],
    [{"action": "dance", "target": "key", "success_condition": "the door is open"}, {"action": "use", "target": 4, "success_condition": None}, {"target": "", "success_condition": "            "}], [{"depends_on": {}}, "x", {"depends_on": 1.5}],
    [{"step_id": "x", "depends_on": ["gone"]}, {"step_id": "y"}, {"step_id": "z"}], LONG, [*LONG[1:], {"step_id": "s0", "depends_on": ["s299", "lost", "lost", None]}],
]
OTHERS = [
    {"title": "long", "giver_npc": "ana", "start_location": "mill", "rewards": [{"type": "item", "value": "key"}, {"type": "item", "value": "mill"}, {"type": "gold", "value": 3}, 4], "completion_conditions": ["Completar todos os objetivos", None], "preconditions": ["a porta está disponível"]},
    {"title": None, "Title": 1.5, "giver_npc": " ana ", "start_location": None, "rewards": "none", "completion_conditions": "x", "preconditions": [1, True, {}], "more": 1}, {"title": 3, "giver_npc": "key", "start_location": "ana", "rewards": [{"type": 1, "value": "key", "x": 1}], "completion_conditions": ["a", "a", 5]},
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [{"quest_id": f"a{i}_{j}", "objectives": s, **o} for i, s in enumerate(STEPS) for j, o in enumerate(OTHERS)] + [{"quest_id": "b", "title": "ten"}, {"quest_id": 5}]
    rows = spark.createDataFrame([(f"n{i}", i, json.dumps(x)) for i, x in enumerate(rows)], "quest_id string, ord long, t string")
    return rows.select("quest_id", "ord", F.parse_json("t").alias("v"))


@pytest.fixture(scope="module")
def app(spark):
    kinds = [("ana", "npc"), ("mill", "location"), ("key", "item"), ("key", "object"), ("odd", None), ("nation_1", "location")]
    return experiments.build_application(spark.createDataFrame(kinds, "entity_id string, entity_type string"), SCHEMA, COMPAT)


def test_schema_issues_are_counted(odd):
    more = [F.parse_json(F.lit(x)) for x in ("[1, 2]", "null", '"text"')]
    rows = odd.select("v").unionAll(odd.limit(1).select(F.explode(F.array(*more)).alias("v")))
    assert {r.a - r.b for r in rows.select(F.size(issues_of(F.col("v"), SCHEMA)).alias("a"), count_of(F.col("v"), SCHEMA).alias("b")).collect()} == {0}
    with pytest.raises(ValueError, match="does not know"):
        count_of(F.col("v"), {"items": {"oneOf": []}})


def test_report_counts_issue_rows(spark, odd, app):
    rows = odd.unionByName(odd.limit(1).withColumn("quest_id", F.lit(None).cast("string")))
    own = {(r.quest_id, r.validator): (r.errors, r.warnings) for r in app.report(rows).collect()}
    count = lambda s: F.count_if(F.col("severity") == s)
    told = {(r.quest_id, r.validator): (r.e, r.w) for r in app.validate(odd).groupBy("quest_id", "validator").agg(count("error").alias("e"), count("warning").alias("w")).collect()}
    assert len(own) == (odd.count() + 1) * 4 and {k: x for k, x in own.items() if x != (0, 0)} == told
    other = experiments.build_application(app.entity, SCHEMA, more={"mine": lambda a: a.where("ord = 1").select("quest_id", F.lit("mine").alias("validator"), *[F.lit("error").alias(c) for c in ("code", "severity", "path", "detail")])})
    mine = {r.quest_id: r.errors for r in other.report(odd).where("validator = 'mine'").collect()}
    assert len(mine) == odd.count() and sum(mine.values()) == mine["n1"] == 1


@pytest.mark.parametrize("wrong", ["nation_1", "ana", "nobody", "key", " "])
def test_detected_is_evaluate_of_mutants(odd, app, wrong):
    made = json_faults.mutants(odd, wrong)
    want = json_faults.evaluate(made, app.expected(made), tuple(app.gates), odd, app.validate(odd))
    got = json_faults.detected(odd, app.entity, SCHEMA, COMPAT, wrong)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["q_all_gates", "q_json_fault_detection"])
def test_artifacts_are_built_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.count("/orders.parquet") <= 1
