"""Nodes of JSON artifacts by type, counted in their rows, against the typed graph."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.operators import artifact_graph
from gatewright.plans import catalog, json_catalog  # noqa: F401

TYPES = ("objective", "action", "reward", "tag", "quest")
ODD = [
    {}, {"objectives": "no", "rewards": {}, "reusable_tags": "x"}, {"giver_npc": " tag::a ", "start_location": 3, "reusable_tags": ["a", " a ", "", None, 4], "rewards": [1, {"type": "item", "value": "key"}, {}]},
    {"objectives": [{"step_id": None, "action": " talk ", "target": "prize"}, 5, {"action": 7, "target": "action::talk", "depends_on": [None, "step_003", 2]}, {"step_id": "s", "depends_on": "s"}, {"step_id": "s", "depends_on": ["s"]}], "reusable_tags": ["b"]},
    {"objectives": [{"step_id": {"a": 1}, "target": "n4"}], "rewards": [{"value": "n4::[]"}, {"value": "prize"}], "giver_npc": "prize"},
]


@pytest.mark.parametrize("more", [(), (("prize", "reward"), ("key", "tag"))])
def test_type_counts_are_those_of_the_graph(spark, more):
    rows = spark.createDataFrame([(f"n{i}", i, json.dumps(x)) for i, x in enumerate(ODD)], "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    entity = spark.createDataFrame([("ana", "npc"), *more], "entity_id string, entity_type string")
    nodes, _ = artifact_graph.artifact_graph(rows, entity)
    want = nodes.groupBy("quest_id").agg(*[F.count_if(F.col("type") == t).alias(f"{t}_count") for t in TYPES])
    assert sorted(map(tuple, artifact_graph.type_counts(rows, entity, TYPES).collect())) == sorted(map(tuple, want.collect()))


def test_nodes_are_not_shuffled(spark):
    plan = catalog.QUERIES["q_json_graph_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and plan.count("Aggregate [") == 1 and "max_by" not in plan
