"""Artifacts that share an id or have none; tags in set metrics; cycles, similarity and running lists against brute force."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gatewright.operators import diversity, experiments, gates, generation, repair
from gatewright.sources.artifacts import from_json, keyed, read_files
from gatewright.sources.scratch import keep

ENTITIES = [("ana", "npc"), ("rui", "npc"), ("mill", "location"), ("key", "item")]
SCHEMA = {"properties": {"objectives": {"minItems": 1}}}


def step(target="rui", **more):
    return {"step_id": "s1", "action": "talk", "target": target, "success_condition": "has spoken with rui", **more}


def artifact(**more):
    return {"title": "t", "quest_type": "dialogue", "giver_npc": "ana", "start_location": "mill", "objectives": [step()], "rewards": [], "reusable_tags": ["a", "b"], **more}


@pytest.fixture(scope="module")
def entity(spark):
    return spark.createDataFrame(ENTITIES, "entity_id string, entity_type string")


def loaded(spark, folder, files):
    for name, value in files.items():
        (folder / name).write_text(json.dumps(value))
    return keyed(read_files(spark, str(folder)))


def test_unnamed_artifacts_of_several_files_are_told_apart(spark, entity, tmp_path):
    quests = loaded(spark, tmp_path, {"a.json": [artifact()], "b.json": [artifact(giver_npc="nobody")]})
    assert quests.select("quest_id").distinct().count() == 2
    issues = gates.referential(from_json(quests, entity, repair.ACTION_TYPES)).collect()
    assert [(i.code, i.quest_id.split("/")[-1]) for i in issues] == [("UNKNOWN_ENTITY", "b.json:0")]


def test_artifacts_of_one_id_are_told_apart(spark, entity, tmp_path):
    quests = loaded(spark, tmp_path, {"a.json": [artifact(quest_id="q"), artifact(quest_id="q", giver_npc="nobody"), artifact(quest_id="")], "b.json": [artifact(quest_id="")]})
    names = [r.quest_id for r in quests.orderBy("quest_id").collect()]
    assert len(set(names)) == 4 and {"q", ""} < set(names)
    passes = gates.artifact_passes(experiments.build_application(entity, {}).report(quests))
    assert {r.quest_id.split("#")[0] + "#" * ("#" in r.quest_id): r.passed for r in passes.collect()} == {"": True, "#": True, "q": True, "q#": False}


def test_artifacts_of_one_id_are_repaired_apart(spark, entity):
    rows = [("q", 0, json.dumps(artifact(quest_id="q", giver_npc="mill"))), ("q", 1, json.dumps(artifact(quest_id="q"))), ("r", 0, json.dumps(artifact(quest_id="r", giver_npc="nobody")))]
    df = spark.createDataFrame(rows, "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    gate = lambda a: gates.referential(experiments.views(a, entity))
    records = {(r.quest_id, r.ord): r for r in repair.orchestrate(df, entity, SCHEMA, gate, keep).drop("v", "r").collect()}
    assert {k: (r.passed, r.repaired) for k, r in records.items()} == {("q", 0): (True, True), ("q", 1): (True, False), ("r", 0): (True, True)}
    assert not records["q", 1].changes and records["q", 0].changes


def set_metrics(spark, entity, artifacts):
    rows = [(f"q{i}", i, json.dumps(a)) for i, a in enumerate(artifacts)]
    df = spark.createDataFrame(rows, "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    return diversity.set_metrics(from_json(df, entity, repair.ACTION_TYPES)).first()


def test_tags_count_in_similarity(spark, entity):
    assert set_metrics(spark, entity, [artifact(reusable_tags=["a", "b", "c"]), artifact(reusable_tags=["d", "e", "f"])]).similarity == pytest.approx(1 / 7)
    assert set_metrics(spark, entity, [artifact(reusable_tags=["a", "a", "b"]), artifact(reusable_tags=["b"]), artifact(reusable_tags=None)]).similarity == pytest.approx((2 / 3 + 1 / 3 + 1 / 2) / 3)
    assert set_metrics(spark, entity, [artifact()]).similarity == 0


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_similarity_with_a_feature_that_all_share(spark, block):
    r = random.Random(9)
    sets = [["all", *r.sample("abcdefgh", r.randint(0, 4))] for _ in range(60)] + [["all"], ["all"], ["other"], []]
    df = spark.createDataFrame([(i, sorted(s), "m", 0) for i, s in enumerate(sets)], "quest_id long, features array<string>, m string, block int").repartition(3)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = [share(set(a), set(b)) for a, b in combinations(sets, 2)]
    assert diversity.pairwise_similarity(df.select("quest_id", "features"), block).first().similarity == pytest.approx(sum(want) / len(want))
    plan = diversity.pairwise_similarity(df, block)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "explode(features" not in plan
    assert diversity.pairwise_similarity(df.limit(0), block).first().similarity == 0


@pytest.mark.parametrize("few", [0, 2, 3, 16])
def test_similarity_by_subsets_and_by_blocks(spark, few):
    r = random.Random(4)
    sets = [r.sample("abcdefgh", r.randint(0, 6)) for _ in range(70)] + [[], ["a"], ["a"]]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "quest_id long, features array<string>").repartition(3)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = [share(set(a), set(b)) for a, b in combinations(sets, 2)]
    assert diversity.pairwise_similarity(df, 5, few).first().similarity == pytest.approx(sum(want) / len(want))


def test_similarity_of_small_sets_makes_no_pairs_of_blocks(spark):
    df = spark.range(300).selectExpr("id AS quest_id", "array(concat('a', id % 50), concat('b', id % 70)) AS features")
    assert "InArrow" not in diversity.pairwise_similarity(df, 10)._jdf.queryExecution().toString()


def simple_cycles(edges):
    out = []

    def walk(path):
        for a, b in edges:
            if a == path[-1] and b == path[0]:
                out.append(path)
            elif a == path[-1] and b > path[0] and b not in path:
                walk([*path, b])

    for x in sorted({a for a, _ in edges}):
        walk([x])
    return sorted(out, key=lambda c: (len(c), c))


def test_first_cycles_against_all_cycles(spark):
    r = random.Random(10)
    graphs = [sorted({(r.randint(1, 6), r.randint(1, 6)) for _ in range(r.randint(0, 14))}) for _ in range(60)] + [[(1, 1)], [(1, 2), (2, 3)], []]
    rows = [(i, [{"src": a, "dst": b} for a, b in g], sorted({x for e in g for x in e})) for i, g in enumerate(graphs)]
    df = spark.createDataFrame(rows, "i int, edges array<struct<src: long, dst: long>>, nodes array<long>")
    cycles = gates.first_cycles(F.col("edges"), F.col("nodes"))
    got = {x.i: (x.c, x.t) for x in df.select("i", cycles.alias("c"), gates.shown_cycles(cycles, False).alias("t")).collect()}
    for i, g in enumerate(graphs):
        assert got[i] == (simple_cycles(g)[:3], str(simple_cycles(g)[:3])), g


def test_cycles_of_named_steps(spark, entity):
    steps = [step(step_id="it's", depends_on=["b"]), step(step_id="b", depends_on=["it's", "b"])]
    df = spark.createDataFrame([("q", 0, json.dumps(artifact(objectives=steps)))], "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    [issue] = gates.graph(from_json(df, entity, repair.ACTION_TYPES)).collect()
    assert issue.code == "CYCLIC_OBJECTIVE_DEPENDENCY" and issue.detail == r"[['b'], ['b', 'it\'s']]"


def test_running_lists_without_one_task(spark):
    r = random.Random(11)
    batches = sorted(r.sample(range(-300, 2000), 200))
    accepted = [(b, i, r.choice(["", "x", "y", "z"])) for b in batches for i in range(r.randint(0, 3))]
    told = generation.forbidden_signatures(spark.createDataFrame(accepted, "batch long, ord long, signature string"), spark.createDataFrame([(b,) for b in batches], "batch long"))
    got = {x.batch: x.signatures for x in told.collect()}
    assert got == {b: [s for c, _, s in accepted if c < b and s] for b in batches}
    assert "Window" in (plan := told._jdf.queryExecution().executedPlan().toString()) and "SinglePartition" not in plan.split("numbers")[0]
