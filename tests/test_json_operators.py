"""Operators over JSON artifacts, recorded responses and run folders, on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F
from test_repair import ENTITY, GENERIC, GOOD, NOTES, RESCUE, SCHEMA, artifacts

from gatewright.operators import artifact_graph, diversity, experiments, gates, generation, json_faults, repair, sinks
from gatewright.operators.diversity_repair import Fold, folded
from gatewright.sources import runs
from gatewright.sources.artifacts import keyed

BAD = {**GOOD, "quest_id": "bad", "objectives": [{"step_id": "s1", "action": None, "target": "rui", "depends_on": "s9", "success_condition": "spoken with rui"}, {"action": 7, "target": " ana ", "depends_on": None}, {"step_id": "s3", "target": "ghost"}], "giver_npc": " ana "}


@pytest.fixture(scope="module")
def entity(spark):
    return spark.createDataFrame(ENTITY, "entity_id string, entity_type string")


@pytest.fixture(scope="module")
def app(entity):
    return experiments.build_application(entity, SCHEMA)


def keeper(spark, path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(str(path / name))
        return spark.read.parquet(str(path / name))

    return keep


def test_views_of_odd_artifacts(spark, entity):
    v = experiments.views(artifacts(spark, GOOD, BAD), entity)
    assert {(r.quest_id, r.path) for r in gates.graph(v).where("code = 'INVALID_DEPENDENCY_LIST'").collect()} == {("bad", "objectives[0].depends_on")}
    assert {r.signature for r in diversity.signatures(v).where("quest_id = 'bad'").collect()} == {"none:npc -> 7:npc -> unknown:unknown"}
    c = diversity.coverage(v).first()
    assert c.coverage <= 1 and c.used == 4  # ana, rui, key and mill, as the catalog writes them


def test_faults_of_json_artifacts(spark, app):
    made = json_faults.mutants(artifacts(spark, GOOD, {"quest_id": "none"}), "key").cache()
    assert sorted(r.fault_type for r in made.where("origin = 'none'").collect()) == ["generic_completion", "missing_required_field", "wrong_giver_type"]
    good = made.where("origin = 'good'")
    rows = json_faults.evaluate(good, app.validate(good.select("quest_id", "v")), tuple(app.gates), artifacts(spark, GOOD).select("quest_id"), app.validate(artifacts(spark, GOOD))).collect()
    got = {(r.scope, r.name): (r.tp, r.fp, r.fn, r.tn) for r in rows}
    assert {k: x for k, x in got.items() if k[0] == "fault"} == {("fault", f): (1, 0, 0, 0) for f in json_faults.FAULTS}
    assert {k[1]: x for k, x in got.items() if k[0] == "validator"} == {"schema": (1, 0, 6, 1), "referential": (3, 0, 4, 1), "graph": (2, 0, 5, 1), "content": (1, 0, 6, 1)}
    assert got[("architecture", "all")] == (7, 0, 0, 1)


def test_typed_graph(spark, entity):
    nodes, edges = artifact_graph.artifact_graph(artifacts(spark, GOOD), entity)
    assert {(r.src, r.dst): r.relation for r in edges.collect()} == {
        ("good", "ana"): "given_by", ("good", "mill"): "starts_at", ("good", "good::step_001"): "has_objective", ("good", "good::step_002"): "has_objective", ("good::step_001", "good::step_002"): "precedes",
        ("good::step_001", "action::talk"): "uses_action", ("good::step_001", "rui"): "targets", ("good::step_001", "good::step_001::success"): "has_success_condition",
        ("good::step_002", "action::collect"): "uses_action", ("good::step_002", "key"): "targets", ("good::step_002", "good::step_002::success"): "has_success_condition",
        ("good", "good::reward_1"): "rewards_with", ("good::reward_1", "key"): "has_value", ("good", "tag::a"): "has_tag", ("good", "tag::b"): "has_tag",
    }
    assert {r.node: r.type for r in nodes.where("node in ('ana', 'key', 'mill', 'good')").collect()} == {"ana": "npc", "key": "item", "mill": "location", "good": "quest"}
    m = artifact_graph.graph_metrics(artifacts(spark, GOOD, {"quest_id": "alone"}, {"quest_id": "apart", "objectives": [{"depends_on": ["x"]}, {"target": "ghost"}]}), entity)
    m = {r.quest_id: r for r in m.collect()}
    g = m["good"]
    assert (g.node_count, g.edge_count, g.connected_components, g.max_depth, g.objective_count, g.world_reference_count) == (14, 15, 1, 2, 2, 4)
    assert g.density == pytest.approx(15 / (14 * 13)) and g.max_degree_centrality == pytest.approx(7 / 13)
    assert (m["alone"].node_count, m["alone"].max_degree_centrality, m["alone"].density) == (1, 1.0, 0.0)
    assert (m["apart"].connected_components, m["apart"].implicit_node_count, m["apart"].objective_count) == (1, 1, 3)


def test_choices_of_the_fold(spark, entity):
    fold = Fold(dict(ENTITY), list(repair.ACTION_TYPES))
    assert fold.action_for("npc", "dialogue", "talk") == "talk" and fold.action_for("npc", "combat", "travel") == "talk"
    assert fold.action_for("location", "exploration", "dance") == "investigate" and fold.action_for("faction", "combat", "dance") == "interact"
    fold.register("", ["axe", "axe", "key"])
    assert fold.least_used("item") == "key" and fold.least_used("npc", without=("ana",)) == "bia" and fold.least_used("none") is None
    assert fold.core("collect", "ghost", "", "rescue", "mill")[:2] == ("collect", "chest")
    one = [("talk", "ana", "")]
    first = fold.support(one, "dialogue", "ana", "mill")
    fold.register(fold.signature([first, *one]), ["mill"], 3)
    assert fold.support(one, "dialogue", "ana", "mill")[:2] != first[:2]
    quests = [{**RESCUE, "quest_id": f"q{i}", "giver_npc": "nobody", "rewards": [{"type": "item", "value": "x"}]} for i in range(3)]
    got = repair.repair(artifacts(spark, *quests), entity, SCHEMA, folded(entity, SCHEMA)).select("ord", F.to_json("r").alias("j"), "changes").orderBy("ord").collect()
    out = [json.loads(r.j) for r in got]
    assert [q["giver_npc"] for q in out] == ["bia", "rui", "bia"] and [q["rewards"][0]["value"] for q in out] == ["axe", "key", "key"]
    assert len({tuple((o["action"], o["target"]) for o in q["objectives"]) for q in out}) == 3
    assert any(c.code == "DIVERSITY_AWARE_OBJECTIVE_REPAIR" for c in got[0].changes)


def test_generation_from_recorded_responses(spark):
    quest = lambda k: {"title": k, "summary": "s", "objectives": []}
    answers = [(1, 1, json.dumps({"quests": [quest("a"), 5]})), (1, 2, "broken"), (1, 3, json.dumps([quest("b"), quest("c"), quest("d")])), (1, 4, json.dumps([quest("never read")])), (2, 1, json.dumps([quest("e")]))]
    made, stats = generation.generated(spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "batch int, n int"), spark.createDataFrame(answers, "batch int, call int, response string"), "mode", "model")
    assert [(r.quest_id, r.ord, r.t) for r in made.select("quest_id", "ord", F.try_variant_get("v", "$.title", "string").alias("t")).orderBy("ord").collect()] == [("batch_01_quest_001", 1, "a"), ("batch_01_quest_002", 2, "b"), ("batch_01_quest_003", 3, "c")]
    assert {r.batch: (r.returned, r.call_count, r.collected, r.shortfall, r.completed) for r in stats.collect()} == {1: ([1, 0, 3], 3, 3, 0, True), 2: ([1], 1, 1, 1, False), 3: ([], 0, 0, 1, False)}
    assert tuple(generation.generation_summary(stats).first()) == (3, 4, 6, 4, 2)
    told = generation.forbidden_signatures(spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (1, 3, ""), (2, 1, "z")], "batch int, ord int, signature string"), spark.range(1, 4).select(F.col("id").alias("batch")))
    assert {r.batch: r.signatures for r in told.collect()} == {1: [], 2: ["x", "y"], 3: ["x", "y", "z"]}
    v = spark.createDataFrame([("a", 1, '{"semantic_scores": {"x": true}, "issues": []}'), ("a", 2, '{"semantic_scores": {"x": 4}, "issues": []}'), ("a", 3, '{"semantic_scores": {"x": 1}, "issues": []}'), ("b", 1, "[]")], "quest_id string, attempt int, t string").select("quest_id", "attempt", F.parse_json("t").alias("v"))
    seen = generation.reviews(spark.createDataFrame([("a",), ("b",)], "quest_id string"), v, ("x",))
    assert {r.quest_id: (r.attempt, r.available) for r in seen.collect()} == {"a": (2, True), "b": (None, False)}
    assert [r.severity for r in generation.unavailable(seen).collect()] == ["warning"]
    scores = spark.createDataFrame([(t,) for t in ("3", "true", '"no"', "null", "2.0")], "t string").select(F.parse_json("t").alias("v"))
    assert generation.mean_score(scores).first().score == 2.0 and generation.mean_score(scores.where("false")).first().score == 0.0


def test_replay_and_runs(spark, tmp_path):
    requests = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 0)], "run string, i int")
    kept = [("a", 0, "text", True, "stop", None), ("a", 1, "cut", False, "length", None), ("a", 2, "half", False, None, None), ("a", 3, " ", True, "stop", None), ("a", 4, None, None, None, "timeout")]
    got = runs.replayed(requests, spark.createDataFrame(kept, "run string, i int, response string, done boolean, done_reason string, failure string"), ["run", "i"])
    assert {(r.run, r.i): (r.outcome, r.response) for r in got.collect()} == {("a", 0): ("ok", "text"), ("a", 1): ("truncated", "cut"), ("a", 2): ("unfinished", None), ("a", 3): ("empty", None), ("a", 4): ("timeout", None), ("a", 5): ("missing", None), ("b", 0): ("missing", None)}
    seeds = runs.request_seeds(requests, 2147483645, ["i"], ["run"])
    assert sorted(r.seed for r in seeds.where("run = 'a'").collect()) == [0, 1, 2, 3, 2147483645, 2147483646] and seeds.where("run = 'b'").first().seed == 2147483645
    assert runs.request_seeds(requests, None, ["i"]).where("seed is not null").isEmpty()
    files = spark.createDataFrame([(1, '[{"a":1},{}]'), (2, "[{},3]"), (3, "{}")], "batch int, t string").select("batch", F.parse_json("t").alias("v"))
    assert {r.batch: r.done for r in runs.finished_batches(spark.createDataFrame([(b, 2) for b in (1, 2, 3, 4)], "batch int, n long"), files).collect()} == {1: True, 2: False, 3: False, 4: False}
    for run in "xy":
        (tmp_path / run).mkdir()
        (tmp_path / run / "c.json").write_text(json.dumps({"configurations": {"C1": {"n": 1}, "other": 2}} if run == "x" else {"C1": 3, "seed": 4}))
    table = runs.run_files(spark, {r: str(tmp_path / r) for r in "xy"}, ["c.json"])
    assert {(r.run, r.configuration) for r in runs.configurations(table).collect()} == {("x", "C1"), ("x", "other"), ("y", "C1")}
    with pytest.raises(FileNotFoundError, match="d.json"):
        runs.run_files(spark, {"x": str(tmp_path / "x")}, ["d.json"])
    assert runs.first_present(spark, [str(tmp_path / "none"), str(tmp_path / "x")]) == str(tmp_path / "x")
    assert runs.resolved(None, "/r", "d.json") == "/r/d.json" and runs.resolved("a", "/r", "d") == "/r/a" and runs.resolved("/a", "/r", "d") == "/a"
    two = keyed(spark.createDataFrame([(0, json.dumps(GOOD)), (1, json.dumps({**dict(reversed(GOOD.items())), "quest_id": "z"})), (2, json.dumps(GENERIC))], "ord int, t string").select("ord", F.parse_json("t").alias("v")))
    assert len({r.f for r in two.select(runs.fingerprint(F.col("v")).alias("f")).collect()}) == 2
    assert runs.file_hash(spark, str(tmp_path / "x" / "c.json")).count() == 1


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([("y", 2.5)], "q string, r double")
    assert sinks.save_csv([a, b], str(tmp_path / "c")) and not sinks.save_csv([a.where("false")], str(tmp_path / "none")) and not (tmp_path / "none").exists()
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["p", "q", "r"] and {tuple(r) for r in back.collect()} == {("1", "x", None), (None, "y", "2.5")}
    sinks.save_json(artifacts(spark, GOOD), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == GOOD
    sinks.save_raw(spark.createDataFrame([("a", 1, "one\n"), ("a", 2, "two")], "quest_id string, attempt int, response string"), str(tmp_path / "raw"), "quest_id")
    assert {r.name for r in spark.read.text(str(tmp_path / "raw")).collect()} == {"a_attempt_1", "a_attempt_2"}


def test_experiment(spark, app, tmp_path):
    quests = artifacts(spark, GOOD, RESCUE, GENERIC, {**RESCUE, "quest_id": "other"})
    keep = keeper(spark, tmp_path)
    out = experiments.experiment(app, artifacts(spark, GENERIC), quests, keep)
    rows = {c: out[c].first() for c in ("C1", "C2", "C3", "C4", "C5")}
    assert {c: (r.total, r.valid, r.published, r.rejected) for c, r in rows.items()} == {"C1": (1, 0, 1, 0), "C2": (4, 1, 4, 0), "C3": (4, 1, 1, 3), "C4": (3, 3, 3, 1), "C5": (3, 3, 3, 1)}
    assert rows["C4"].avg_errors == 0 and rows["C5"].valid_unique_signatures >= rows["C4"].valid_unique_signatures
    assert {r.quest_id for r in out["records_C4"].where("not passed").collect()} == {"generic"}
    values = experiments.long_metrics([out["C4"], out["C5"]], ["validity_rate", "avg_errors"])
    delta = experiments.paired(values.where("configuration = 'C4'"), values.where("configuration = 'C5'"), ["metric"])
    assert {r.metric: r.delta for r in delta.collect()} == {"validity_rate": 0.0, "avg_errors": 0.0}
    s = experiments.numeric_summary(spark.createDataFrame([("a", 1, 2.0), ("a", 0, 4.0), ("b", 0, None), ("c", 0, 1.0)], "k string, ord int, value double"), ["k"])
    assert {r.k: (r["count"], r.mean, round(r.standard_deviation, 3), r["values"]) for r in s.collect()} == {"a": (2, 3.0, 1.414, [4.0, 2.0]), "c": (1, 1.0, 0.0, [1.0])}
    assert len(NOTES) == 3
