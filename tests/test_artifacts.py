"""JSON artifacts through the views and gates, against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.operators import gates
from gatewright.operators.content import content_gate
from gatewright.operators.schema_gate import schema_gate
from gatewright.sources.artifacts import catalog, from_json, keyed, read_files, read_lines, require_unique

WORLD = {"npcs": [{"id": " ana "}, {"id": "rui"}, 7, {"id": ""}], "locations": [{"id": "mill"}], "items": [{"id": "key"}], "enemies": [{"id": "wolf"}]}
COMPAT = {"talk": ("npc",), "collect": ("item", "object"), "defeat": ("enemy", "npc")}
GOOD = {"quest_id": "a", "quest_type": "x", "giver_npc": "ana", "start_location": "mill", "objectives": [{"step_id": "s1", "action": "talk", "target": "rui", "success_condition": "has spoken with rui", "depends_on": []}, {"step_id": "s2", "action": "collect", "target": "key", "success_condition": "holds the old key", "depends_on": ["s1"]}], "rewards": [{"type": "item", "value": "key"}], "completion_conditions": ["the key is held"], "preconditions": []}
BAD = {"quest_id": "b", "giver_npc": "mill", "start_location": "nowhere", "objectives": ["text", {"step_id": "s1", "action": "collect", "target": "wolf", "success_condition": None, "depends_on": ["s2", "s9"]}, {"step_id": "s1", "action": "dance", "target": "wolf"}, {"step_id": "s2", "action": "talk", "target": "ghost", "success_condition": "speaks to the ghost", "depends_on": ["s1"]}], "rewards": [{"type": "item", "value": "ana"}, {"type": "currency", "value": "ana"}], "completion_conditions": ["Completar todos os objetivos", 4], "preconditions": ["A torre está disponível"]}
CHAIN = {"objectives": [{"action": "talk", "target": "rui"}, {"action": "talk", "target": "ana"}, 3, {"action": "talk", "target": "rui"}]}


@pytest.fixture(scope="module")
def quests(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("json")
    (at / "set.json").write_text(json.dumps([GOOD, "no object", BAD, CHAIN], indent=1))
    return keyed(read_files(spark, str(at)))


@pytest.fixture(scope="module")
def views(spark, quests):
    world = spark.createDataFrame([(json.dumps(WORLD),)], "t string").select(F.parse_json("t").alias("v"))
    return from_json(quests, catalog(world), COMPAT)


def found(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_catalog(views):
    assert found(views.entity, "entity_id", "entity_type") == [("ana", "npc"), ("key", "item"), ("mill", "location"), ("rui", "npc"), ("wolf", "enemy")]
    require_unique(views.entity)
    with pytest.raises(ValueError, match="ana"):
        require_unique(views.entity.unionByName(views.entity.where("entity_id = 'ana'")))


def test_referential(views):
    assert found(gates.referential(views), "quest_id", "code", "path") == [
        ("b", "DUPLICATE_STEP_ID", "objectives"),
        ("b", "INCOMPATIBLE_ACTION_TARGET", "objectives[1].target"),
        ("b", "INVALID_OR_IMPLICIT_TARGET", "objectives[3].target"),
        ("b", "INVALID_QUEST_GIVER_TYPE", "giver_npc"),
        ("b", "INVALID_REWARD_ITEM_TYPE", "rewards[0].value"),
        ("b", "UNKNOWN_ENTITY", "start_location"),
    ]


def test_graph(views):
    assert found(gates.graph(views), "quest_id", "code", "path") == [("b", "CYCLIC_OBJECTIVE_DEPENDENCY", "objectives"), ("b", "MISSING_STEP_DEPENDENCY", "objectives[1].depends_on")]
    assert found(gates.dependency_edges(views).where("quest_id like '#%'"), "src", "dst") == [("step_001", "step_002"), ("step_002", "step_003")]


def test_content(quests):
    by_place = content_gate(quests).withColumn("quest_id", F.regexp_replace("quest_id", "^#.*:", "#"))  # unnamed: called by file and place
    assert found(by_place, "quest_id", "code", "path") == sorted(
        [("b", "GENERIC_COMPLETION_CONDITION", "completion_conditions[0]"), ("b", "WEAK_PRECONDITION", "preconditions[0]")]
        + [("b", "UNCLEAR_SUCCESS_CONDITION", f"objectives[{i}].success_condition") for i in (1, 2)]
        + [("#3", "UNCLEAR_SUCCESS_CONDITION", f"objectives[{i}].success_condition") for i in (0, 1, 3)]
    )


SCHEMA = {"type": "object", "required": ["id", "tags"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^q_[0-9]+$", "minLength": 4}, "kind": {"enum": ["a", "b", 1]}, "n": {"type": ["integer", "null"], "minimum": 2}, "tags": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "string"}}, "steps": {"type": "array", "items": {"type": "object", "required": ["s"], "properties": {"s": {"type": "string", "maxLength": 2}}}}}}
CASES = [
    ('{"id":"q_12","tags":["x"],"kind":1.0,"n":3.0}', []),
    ('{"id":"q_1","tags":[]}', [("id", "minLength"), ("tags", "minItems")]),
    ('{"id":7,"tags":["x","x",1,true],"kind":"c"}', [("id", "type"), ("kind", "enum"), ("tags", "maxItems"), ("tags", "uniqueItems"), ("tags.2", "type"), ("tags.3", "type")]),
    ('{"n":null,"z":1,"y":2}', [("", "additionalProperties"), ("", "required"), ("", "required")]),
    ('{"id":"q_12","tags":["x"],"n":1.5}', [("n", "minimum"), ("n", "type")]),
    ('{"id":"q_12","tags":[1,true,"1"],"n":1}', [("n", "minimum"), ("tags.0", "type"), ("tags.1", "type")]),
    ('{"id":"q_12","tags":["x"],"steps":[{"s":"ab"},{"s":"abc"},{},4]}', [("steps.1.s", "maxLength"), ("steps.2", "required"), ("steps.3", "type")]),
    ('{"id":null,"tags":"x"}', [("id", "type"), ("tags", "type")]),
    ("[1]", [("", "type")]),
    ("null", [("", "type")]),
]


def test_schema(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "quest_id int, t string").select("quest_id", F.parse_json("t").alias("v"))
    got = found(schema_gate(df, SCHEMA), "quest_id", "path", "keyword")
    assert got == sorted((i, *x) for i, (_, xs) in enumerate(CASES) for x in xs)
    order = [r.path for r in schema_gate(df.where("quest_id = 2"), SCHEMA).orderBy("seq").collect()]
    assert order == sorted(order, key=lambda p: p.split("."))
    with pytest.raises(ValueError, match="oneOf"):
        schema_gate(df, {"oneOf": []})


def test_empty_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"quest_id":"a"}\nnot json\n[1]\n')
    rows = read_lines(spark, str(tmp_path))
    assert rows.count() == 2 and keyed(rows).count() == 1
    none = keyed(rows.where("false"))
    assert schema_gate(none, SCHEMA).count() == content_gate(none).count() == 0
