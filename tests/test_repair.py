"""Deterministic repair and its orchestration on hand-made artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.operators import gates, repair
from gatewright.operators.content import content_gate
from gatewright.operators.schema_gate import schema_gate
from gatewright.sources.artifacts import from_json, keyed

ENTITY = [("ana", "npc"), ("bia", "npc"), ("rui", "npc"), ("mill", "location"), ("cave", "location"), ("key", "item"), ("axe", "item"), ("wolf", "enemy"), ("guild", "faction"), ("chest", "object")]
TEXT = lambda n: {"type": "string", "minLength": n}
STEP = {"type": "object", "required": ["step_id", "depends_on", "action", "target", "success_condition"], "properties": {"step_id": {"type": "string", "pattern": "^step_[0-9]{3}$"}, "depends_on": {"type": "array"}, "action": {"type": "string", "enum": list(repair.ACTION_TYPES)}, "target": TEXT(1), "success_condition": TEXT(12)}, "additionalProperties": False}
SCHEMA = {
    "type": "object",
    "required": ["quest_id", "title", "summary", "quest_type", "giver_npc", "start_location", "objectives", "preconditions", "completion_conditions", "rewards", "reusable_tags", "design_notes"],
    "properties": {
        "quest_id": {"type": "string", "pattern": "^[a-z0-9_]+$"}, "title": TEXT(3), "summary": TEXT(20), "quest_type": {"type": "string", "enum": ["delivery", "exploration", "rescue", "dialogue"]},
        "giver_npc": TEXT(1), "start_location": TEXT(1), "objectives": {"type": "array", "minItems": 2, "maxItems": 4, "items": STEP}, "preconditions": {"type": "array", "items": TEXT(8)},
        "completion_conditions": {"type": "array", "minItems": 1, "items": TEXT(12)},
        "rewards": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["type", "value"], "properties": {"type": {"enum": ["item", "currency", "reputation", "unlock"]}, "value": {"type": ["string", "number"]}}, "additionalProperties": False}},
        "reusable_tags": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z0-9_]+$"}},
        "design_notes": {"type": "object", "required": list(repair.NOTES), "properties": {k: TEXT(12) for k in repair.NOTES}, "additionalProperties": False},
    },
}
NOTES = {k: "long enough to be kept" for k in repair.NOTES}
GOOD = {"quest_id": "good", "title": "A title", "summary": "A summary that is long enough.", "quest_type": "dialogue", "giver_npc": "ana", "start_location": "mill", "objectives": [{"step_id": "step_001", "depends_on": [], "action": "talk", "target": "rui", "success_condition": "has spoken with rui"}, {"step_id": "step_002", "depends_on": ["step_001"], "action": "collect", "target": "key", "success_condition": "holds the old key"}], "preconditions": [], "completion_conditions": ["the key is held at last"], "rewards": [{"type": "item", "value": "key"}], "reusable_tags": ["a", "b"], "design_notes": NOTES, "more": {"x": [1]}}
EMPTY = {"quest_id": " ", "generation_mode": "m"}
RESCUE = {**GOOD, "quest_id": "rescue", "giver_npc": " ana ", "objectives": [{"action": " Rescue ", "target": "ana", "success_condition": "x"}], "rewards": [{"type": "item", "value": "nothing"}, 3, {"type": "currency", "value": "much"}, {"type": "unlock", "value": " "}, {"type": "gold", "value": 1}], "reusable_tags": ["Água Fria", "agua_fria", 7], "preconditions": [" kept as it is ", "", 4], "title": "ok"}
STEPS = {**GOOD, "quest_id": "steps", "quest_type": "nonsense", "start_location": "ana", "objectives": [{"action": "dance", "target": "wolf", "success_condition": "dances with the wolf"}, "text", {"action": "travel", "target": "rui", "success_condition": "short"}, {"action": "sing", "target": "nobody", "success_condition": ""}, {"action": "defeat", "target": "nobody", "success_condition": None}, {"action": "talk", "target": "ana", "success_condition": "one objective too many"}], "completion_conditions": ["short", 5], "design_notes": {"reuse_potential": " kept and stripped ", "extra": 1}}
GENERIC = {**GOOD, "quest_id": "generic", "completion_conditions": ["Completar todos os objetivos da quest"]}


@pytest.fixture(scope="module")
def entity(spark):
    return spark.createDataFrame(ENTITY, "entity_id string, entity_type string")


def artifacts(spark, *quests):
    return keyed(spark.createDataFrame([(i, json.dumps(q)) for i, q in enumerate(quests)], "ord int, t string").select("ord", F.parse_json("t").alias("v")))


def gate(entity):
    def run(df):
        cols = ("quest_id", "code", "severity")
        v = from_json(df.withColumn("ord", F.lit(0)), entity, repair.ACTION_TYPES)
        return gates.union([x.select(*cols) for x in (schema_gate(df, SCHEMA), gates.referential(v), gates.graph(v), content_gate(df))])

    return run


def result(df):
    return {r.ord: (json.loads(r.j), {c.code: (c.path, c.before, c.after) for c in r.changes}) for r in df.select("ord", F.to_json("r").alias("j"), "changes").collect()}


def test_rules(spark, entity):
    got = result(repair.repair(artifacts(spark, GOOD, EMPTY, RESCUE, STEPS, GENERIC), entity, SCHEMA))
    assert got[0] == (GOOD, {})
    q, changes = got[1]
    assert (q["quest_id"], q["title"], q["quest_type"], q["giver_npc"], q["start_location"]) == ("quest_repaired_001", "Missão restaurada", "exploration", "ana", "cave")
    assert q["summary"] == "O jogador deve concluir os objetivos definidos para Missão restaurada."
    assert [(o["step_id"], o["depends_on"], o["action"], o["target"]) for o in q["objectives"]] == [("step_001", [], "travel", "cave"), ("step_002", ["step_001"], "talk", "ana")]
    assert q["completion_conditions"] == [q["objectives"][1]["success_condition"]] == ["O jogador conclui o diálogo com ana."]
    assert q["rewards"] == [{"type": "currency", "value": 100}] and q["reusable_tags"] == ["exploration", "travel"] and q["preconditions"] == [] and q["generation_mode"] == "m"
    assert set(q["design_notes"]) == set(repair.NOTES) and len(changes) == 12
    q, changes = got[2]
    assert q["giver_npc"] == "bia" and changes["CHANGE_SELF_RESCUE_GIVER"] == ("giver_npc", '" ana "', '"bia"') and q["title"] == "Missão restaurada"
    assert [(o["action"], o["target"]) for o in q["objectives"]] == [("talk", "bia"), ("rescue", "ana")]
    assert q["rewards"] == [{"type": "item", "value": "axe"}, {"type": "currency", "value": 100}, {"type": "unlock", "value": "quest_progression"}]
    assert q["reusable_tags"] == ["agua_fria", "7"] and q["preconditions"] == ["kept as it is"]
    q, _ = got[3]
    assert [(o["action"], o["target"]) for o in q["objectives"]] == [("defeat", "wolf"), ("travel", "cave"), ("interact", "axe"), ("defeat", "wolf")]
    assert q["objectives"][1]["success_condition"] == "O jogador alcança a localização cave." and q["start_location"] == "cave" and q["quest_type"] == "exploration"
    assert q["design_notes"]["reuse_potential"] == "kept and stripped" and q["design_notes"]["extra"] == 1
    assert got[4][0]["completion_conditions"] == GENERIC["completion_conditions"]


def test_orchestration(spark, entity, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    fixed = {**GENERIC, "completion_conditions": ["the key lies in the chest"], "quest_id": "other"}
    answers = [("generic", 1, "no artifact"), ("generic", 2, json.dumps({"quest": fixed})), ("never", 1, "[]")]
    responses = spark.createDataFrame(answers, "quest_id string, attempt int, response string")
    quests = artifacts(spark, GOOD, RESCUE, GENERIC, {**GENERIC, "quest_id": "never"})
    records = keep(repair.orchestrate(quests, entity, SCHEMA, gate(entity), keep, responses, recover=F.try_parse_json), "records")
    assert {r.quest_id: (r.attempts, r.repaired, r.passed) for r in records.collect()} == {"good": (0, False, True), "rescue": (0, True, True), "generic": (2, True, True), "never": (3, False, False)}
    accepted, rejected, rest = repair.routed(records)
    assert {r.quest_id for r in accepted.collect()} == {"good", "rescue", "generic"} and [r.quest_id for r in rejected.collect()] == ["never"] and rest.count() == 4
    assert repair.change_rows(records).where("quest_id = 'good'").isEmpty()
    s = repair.repair_summary(records).first()
    assert (s.total, s.initially_valid, s.valid, s.repair_attempted, s.repaired, s.repair_failed, s.deterministic_only, s.response_rounds) == (4, 1, 3, 3, 2, 1, 1, 5)
    assert s.validity_rate == 0.75 and s.repair_success_rate == pytest.approx(2 / 3)
    assert repair.repair_summary(records.where("false")).first().validity_rate == 0
