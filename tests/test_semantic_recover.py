"""Adjudication of proposals, JSON recovery and streams, against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.functions.recover import extract_artifacts, extract_json, extract_object
from gatewright.operators import semantic
from gatewright.streaming import gates as stream

Q = {"title": "A Guarda Desaparecida", "summary": None, "giver_npc": "ana", "preconditions": ["x"], "objectives": [{"action": "rescue", "target": "ana ", "success_condition": "ana is free now"}, {"action": "fight", "target": "wolf", "success_condition": "the wolf is gone"}, {"action": "fight", "target": "rui", "success_condition": "rui lost the duel"}, {"action": "collect", "target": "key", "success_condition": " Fazer  isso"}, {"action": "talk", "target": "ana", "success_condition": "spoken"}, {"action": "collect", "target": "key", "success_condition": "holds the key"}, {"action": "collect", "target": "wolf", "success_condition": "holds a wolf"}]}
ENTITY = [("ana", "npc"), ("rui", "npc"), ("wolf", "enemy"), ("key", "item")]
PROPOSALS = [
    ("text", "discarded", "issue_not_an_object"),
    ({"code": "ODD"}, "discarded", "unsupported_issue_code"),
    ({"code": " unclear_objective "}, "discarded", "missing_structured_evidence"),
    ({"code": "LOW_REUSABILITY", "evidence": {"rule": "any"}}, "advisory", "subjective_human_review"),
    ({"code": "NARRATIVE_CONTRADICTION", "evidence": {"rule": "giver_is_rescue_target"}}, "accepted", "verified_against_quest_fields"),
    ({"code": "NARRATIVE_CONTRADICTION", "evidence": {"rule": "giver_is_defeat_target"}}, "discarded", "contradicted_by_quest_fields"),
    ({"code": "QUEST_GIVER_STATE_CONTRADICTION", "evidence": {"rule": "giver_unavailable_but_required", "entity_id": "ana"}}, "accepted", "verified_against_quest_fields"),
    ({"code": "IMPLICIT_ENTITY", "evidence": {"rule": "other"}}, "discarded", "unsupported_evidence_rule"),
    ({"code": "IMPLICIT_ENTITY", "evidence": {"rule": "untracked_entity_id"}}, "discarded", "missing_entity_id_evidence"),
    ({"code": "IMPLICIT_ENTITY", "evidence": {"rule": "untracked_entity_id", "entity_id": " rui "}}, "discarded", "entity_exists_in_world"),
    ({"code": "IMPLICIT_ENTITY", "evidence": {"rule": "untracked_entity_id", "entity_id": "zed"}}, "accepted", "entity_absent_from_world"),
    *[({"code": "UNMODELLED_COMBAT_DEPENDENCY", "evidence": {"rule": "combat_target_not_modelled", "objective_index": i}}, *r) for i, r in [(True, ("discarded", "invalid_objective_index")), (9, ("discarded", "invalid_objective_index")), (0, ("discarded", "objective_is_not_combat")), (1, ("discarded", "combat_target_is_modelled_enemy")), (2, ("accepted", "combat_target_not_modelled"))]],
    *[({"code": "UNCLEAR_OBJECTIVE", "evidence": {"rule": "unclear_objective_at_index", "objective_index": i}}, *r) for i, r in [(3, ("accepted", "objective_has_unverifiable_fields")), (4, ("discarded", "objective_is_concrete"))]],
    *[({"code": "UNCLEAR_ITEM_ACQUISITION", "evidence": {"rule": "unclear_item_acquisition_at_index", "objective_index": i}}, *r) for i, r in [(4, ("discarded", "objective_is_not_collection")), (6, ("accepted", "collection_target_is_not_item")), (3, ("accepted", "collection_condition_is_not_verifiable")), (5, ("discarded", "item_acquisition_is_concrete"))]],
]


@pytest.fixture(scope="module")
def judged(spark):
    quest = spark.createDataFrame([("q", json.dumps(Q))], "quest_id string, t string").select("quest_id", F.parse_json("t").alias("v"))
    raw = spark.createDataFrame([("q", i, json.dumps(p[0])) for i, p in enumerate(PROPOSALS)], "quest_id string, n int, t string").select("quest_id", "n", F.parse_json("t").alias("raw"))
    return semantic.adjudicate(semantic.proposals(raw), semantic.facts(quest), spark.createDataFrame(ENTITY, "entity_id string, entity_type string"))


def test_decisions(judged):
    got = {r.n: (r.decision, r.reason) for r in judged.collect()}
    assert got == {i: p[1:] for i, p in enumerate(PROPOSALS)}


def test_scores_and_rollup(spark, judged):
    scores = spark.createDataFrame([("q", "narrative_consistency", 1.0), ("q", "maintainability", 0.0), ("q", "gameplay_clarity", 3.0), ("q", "integration_readiness", -4.0)], "quest_id string, criterion string, score double")
    assert sorted((r.code, r.detail) for r in semantic.low_scores(scores, judged).collect()) == [("LOW_INTEGRATION_READINESS", "0.0"), ("LOW_NARRATIVE_CONSISTENCY", "1.0")]
    r = semantic.rollup(judged).first()
    counts = [sum(p[1] == d for p in PROPOSALS) for d in ("accepted", "advisory", "discarded")]
    assert [r.raw, r.accepted, r.advisory, r.discarded] == [len(PROPOSALS), *counts]
    assert {i.severity for i in semantic.accepted_issues(judged).collect()} == {"error", "warning"}


A = {"quest_id": "1", "title": "t", "objectives": [], "summary": "s"}


def test_recover(spark):
    texts = [None, "", "Here are 3 things", '```json\n{"a": {"b": 1}}\n```', 'Well: [{"result": {"x": "é"}}] ok', json.dumps({"quests": [A, 4]}), '{"quests": [' + json.dumps(A) + ", " + json.dumps(A | {"quest_id": "2"}) + ', {"title": "cut', json.dumps('{"y": 1}')]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r for r in df.select("i", extract_json("t").alias("v"), extract_object("t").alias("o"), extract_artifacts("t").alias("a")).collect()}
    assert [rows[i].v for i in (0, 1, 2, 3)] == [None, None, "3", '{"a": {"b": 1}}']
    assert [rows[i].o for i in (0, 2, 4, 7)] == [None, None, '{"x": "é"}', '{"y": 1}']
    assert [len(rows[i].a) for i in (0, 2, 5, 6)] == [0, 0, 1, 1]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("a", "2024-01-01T00:00:00", 1), ("a", "2024-01-01T00:00:05", 1), ("b", "2024-01-01T00:00:30", "x"), ("c", "2024-01-01T00:20:00", 2)]
    (tmp_path / "in" / "x.jsonl").write_text("\n".join(json.dumps({"id": i, "at": t, "n": n}) for i, t, n in lines))
    source = spark.readStream.text(str(tmp_path / "in")).select(F.try_parse_json("value").alias("v")).select("v", F.expr("v:id::string").alias("id"), F.expr("v:at::timestamp").alias("at"))
    once = stream.first_wins(source, "id", "at", "10 minutes")
    q = stream.judged(once, {"properties": {"n": {"type": "integer"}}}).select("id", "passed").writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("judged").collect())) == [("a", True), ("b", False), ("c", True)]
    rates = stream.acceptance_by_window(spark.table("judged").join(spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:30"), ("c", "2024-01-01 00:20:00")], "id string, t string"), "id").withColumn("at", F.to_timestamp("t")), "at", "10 minutes", "1 minute")
    assert sorted((r.artifacts, r.passed, r.rate) for r in rates.collect()) == [(1, 1, 1.0), (2, 1, 0.5)]
