"""The semantic gate as a whole, prompts, settings, aggregates, reports: against hand-made cases."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from gatewright.operators import generation, prompts, repair, review, semantic, sinks
from gatewright.sources.settings import Settings, run_metadata

QUEST = {"quest_id": "a", "title": "A", "summary": "s", "giver_npc": "ana", "preconditions": ["ana foi sequestrada"], "objectives": [{"action": "collect", "target": "wolf", "success_condition": "has it"}]}
SCORES = dict.fromkeys(semantic.CRITERIA, 4)


def quests(spark, *names):
    rows = [(n, json.dumps({**QUEST, "quest_id": n})) for n in names]
    return spark.createDataFrame(rows, "quest_id string, t string").select("quest_id", F.parse_json("t").alias("v"))


def answers(spark, rows):
    return spark.createDataFrame([(q, n, json.dumps(x)) for q, n, x in rows], "quest_id string, attempt int, t string").select("quest_id", "attempt", F.parse_json("t").alias("v"))


def proposal(code, rule, **more):
    return {"code": code, "path": "p", "evidence": {"rule": rule, **more}}


@pytest.fixture(scope="module")
def entity(spark):
    return spark.createDataFrame([("ana", "npc"), ("wolf", "enemy")], "entity_id string, entity_type string")


def test_semantic_gate(spark, entity):
    low = {**SCORES, "gameplay_clarity": -3, "integration_readiness": 9, "maintainability": 1}
    full = {"semantic_scores": low, "short_review": "ok", "issues": [{**proposal("UNCLEAR_ITEM_ACQUISITION", "unclear_item_acquisition_at_index", objective_index=0), "explanation": "no item"}, proposal("LOW_REUSABILITY", "x"), "text", proposal("NO", "x")]}
    said = [("a", 1, {"issues": []}), ("a", 2, full), ("a", 3, {"semantic_scores": SCORES, "issues": []}), ("b", 1, {"semantic_scores": {**SCORES, "reusability": True}, "issues": []}), ("c", 1, {"semantic_scores": SCORES, "issues": []})]
    issues, records = review.semantic_gate(quests(spark, "a", "b", "c"), answers(spark, said), entity)
    assert sorted((i.quest_id, i.code, i.severity, i.detail) for i in issues.collect()) == [
        ("a", "LOW_GAMEPLAY_CLARITY", "error", "0.0"), ("a", "UNCLEAR_ITEM_ACQUISITION", "warning", "no item"), ("b", "SEMANTIC_VALIDATION_UNAVAILABLE", "warning", "")]
    got = {r.quest_id: r for r in records.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.status, a.attempts, a.short_review, a.raw, a.accepted, a.advisory, a.discarded, a.discarded_rate) == ("completed", 2, "ok", 4, 1, 1, 2, 0.5)
    assert a.overall_score == pytest.approx((4 + 0 + 5 + 4 + 1 + 4) / 6) and a.scores["gameplay_clarity"] == 0
    assert (b.status, b.attempts, b.scores, b.overall_score, b.short_review, b.raw, b.discarded_rate) == ("unavailable", 3, None, None, "", 0, 0)
    assert (c.status, c.raw, c.discarded_rate, c.overall_score) == ("completed", 0, 0, 4)


def test_one_attempt_answered_twice_is_the_first_as_json(spark):
    two = [("a", 1, {"semantic_scores": {"x": 2}, "issues": []}), ("a", 1, {"semantic_scores": {"x": 1}, "issues": []})]
    for order in (two, two[::-1]):
        seen = generation.reviews(quests(spark, "a"), answers(spark, order), ("x",)).select(F.to_json("review").alias("j")).first().j
        assert json.loads(seen)["semantic_scores"]["x"] == 1


def test_message_of_a_proposal_without_explanation(spark):
    raw = spark.createDataFrame([("a", 0, "{}"), ("a", 1, '{"explanation": null}'), ("a", 2, '{"explanation": "why"}')], "quest_id string, n int, t string").select("quest_id", "n", F.parse_json("t").alias("raw"))
    assert [r.message for r in semantic.proposals(raw).orderBy("n").collect()] == [semantic.NO_MESSAGE, "None", "why"]


def test_prompts_hold_what_they_must(spark):
    a = quests(spark, "a")
    catalog, schema = {"npc": ["ana"]}, {"required": ["title"]}
    issues = spark.createDataFrame([("a", "graph", "CYCLIC", "error", "objectives", "[[1]]"), ("a", "content", "NOTE", "info", "", "")], "quest_id string, validator string, code string, severity string, path string, detail string")
    text = prompts.repair_prompt(a, issues, catalog, schema, 2).first().prompt
    assert "attempt 2" in text and '"CYCLIC"' in text and "NOTE" not in text and '"ana"' in text and '"required"' in text and '"quest_id":"a"' in text
    assert "[]" in prompts.repair_prompt(a, issues.where("false"), catalog, schema, 1).first().prompt
    asked = [prompts.review_prompt(a, ['{"id":"ana"}'], n).first().prompt for n in (1, 2, 3)]
    assert all(all(c in p for c in (*semantic.SEVERITY, *prompts.EVIDENCE, *semantic.CRITERIA)) and '{"id":"ana"}' in p for p in asked)
    assert "RETRY" not in asked[0] and asked[1].startswith(asked[0]) and len(asked[2]) > len(asked[1])
    requests = spark.createDataFrame([(1, 3), (12, 4)], "batch int, n int")
    told = spark.createDataFrame([(12, ["talk:npc"])], "batch int, signatures array<string>")
    made = {r.batch: r.prompt for r in prompts.generation_prompt(requests, catalog, schema, told).collect()}
    assert "batch_12_quest_NNN" in made[12] and '["talk:npc"]' in made[12] and "list of 3 " in made[1] and "[]" in made[1] and '"required"' in made[1]
    assert "RULES" not in prompts.baseline_prompt(requests, catalog).first().prompt
    whole = prompts.set_review_prompt(generation.set_review_rows(quests(spark, "a", "b")), {"entropy": 0.5}).first().prompt
    assert all(c in whole for c in prompts.SET_CRITERIA) and '"entropy": 0.5' in whole and whole.count('"title":"A"') == 2


def test_settings_and_metadata(spark):
    s = Settings.from_project_root("/p/", top_p=0.5)
    assert (s.world_path, s.schema_path, s.output_dir, s.top_p, s.max_repair_attempts) == ("/p/data/world.json", "/p/data/quest_schema.json", "/p/outputs", 0.5, 3)
    m = run_metadata(spark, s, None, 3, 10).first()
    assert (m.run_seed, m.seed_strategy, m.total_quests_per_configuration, m.top_p) == (None, "run_seed_plus_request_index", 30, 0.5)


def test_aggregate_of_runs(spark, tmp_path):
    runs = spark.createDataFrame([("r1", 7, "x", "p"), ("r2", 8, "x", "q")], "run string, run_seed long, c2_hash string, c5_hash string")
    values = spark.createDataFrame([("r1", "C1", "errors", 1.0), ("r2", "C1", "errors", 3.0), ("r1", "C2", "errors", 0.0), ("r1", "C1", "other", 9.0)], "run string, configuration string, metric string, value double")
    metrics = {"configuration": ["errors", "warnings"], "diversity": ["entropy"]}
    sinks.save_aggregate(str(tmp_path), runs, values, values.where("false"), metrics)
    [part] = (tmp_path / "configuration_metrics").glob("part-*.csv")
    assert list(csv.reader(part.open())) == [["run", "run_seed", "configuration", "errors", "warnings"], ["r1", "7", "C1", "1.0", ""], ["r1", "7", "C2", "0.0", ""], ["r2", "8", "C1", "3.0", ""]]
    [head] = (tmp_path / "diversity_metrics").glob("part-*.csv")
    assert head.read_text().strip() == "run,run_seed,configuration,entropy"
    [told] = (tmp_path / "summary").glob("part-*.json")
    told = json.loads(told.read_text())
    assert (told["run_count"], told["all_run_seed_unique"], told["all_c2_hash_unique"], told["all_c5_hash_unique"]) == (2, True, False, True)
    assert [(m["configuration"], m["metric"], m["count"], m["mean"], m["standard_deviation"]) for m in told["configuration_metrics"]] == [("C1", "errors", 2, 2.0, pytest.approx(2**0.5)), ("C2", "errors", 1, 0.0, 0.0)]


def test_console_summary(spark):
    row = spark.createDataFrame([(4, 1, 0.25)], "total long, passed long, rate double")
    by = spark.createDataFrame([("schema", 1, 3, 5, 0)], "validator string, passed long, failed long, errors long, warnings long")
    assert sinks.console(row, by, {"total": "Total", "rate": "Rate"}).splitlines() == ["Total: 4", "Rate: 25.00%", "- schema: 1 PASS, 3 FAIL, 5 errors, 0 warnings"]


def test_notes_about_nothing_are_as_they_are(spark):
    notes = spark.range(1).select(*[repair.said(t, F.lit("T")).alias(k) for k, t in repair.NOTES.items()]).first()
    assert notes.reuse_potential == repair.NOTES["reuse_potential"] and notes.intended_player_experience.endswith("objetivos de T.")
