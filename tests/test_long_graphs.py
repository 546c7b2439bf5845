"""Graphs of long artifacts: the linear way against the expressions, and against a clock."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gatewright.operators import gates, repair
from gatewright.operators.long_graphs import Graph
from gatewright.sources.artifacts import from_json


def views(spark, graphs):
    """Artifacts whose step i depends on the steps that graphs name."""
    rows = []
    for i, steps in enumerate(graphs):
        objectives = [{"step_id": s, "depends_on": deps, "action": "talk", "target": "ana", "success_condition": "long enough"} for s, deps in steps]
        rows.append((f"q{i}", i, json.dumps({"quest_id": f"q{i}", "objectives": objectives})))
    df = spark.createDataFrame(rows, "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    return from_json(df, spark.createDataFrame([("ana", "npc")], "entity_id string, entity_type string"), repair.ACTION_TYPES)


def random_graphs(n):
    r = random.Random(12)
    out = []
    for _ in range(n):
        names = [f"s{i}" for i in range(r.randint(1, 7))]
        out.append([(s, r.sample(names + ["phantom"], r.choice([0, 0, 1, 1, 2]) if len(names) > 1 else r.randint(0, 1))) for s in names])
    return out


def rows(df, *cols):
    return sorted((tuple(map(str, (r[c] for c in cols))) for r in df.collect()))


@pytest.mark.parametrize("long", [0, 3])
def test_both_ways_agree(spark, long):
    v = views(spark, random_graphs(60))
    facts = ("quest_id", "cyclic", "n_nodes", "n_edges", "roots", "terminals")
    assert rows(gates.graph_facts(v, long), *facts) == rows(gates.graph_facts(v), *facts)
    metrics = gates.graph_metrics(v).columns
    assert rows(gates.graph_metrics(v, long), *metrics) == rows(gates.graph_metrics(v), *metrics)


def test_ten_thousand_steps(spark):
    n = 10_000
    chain = [(f"s{i:05d}", [f"s{i - 1:05d}"] if i else []) for i in range(n)]
    ring = [(s, deps or [f"s{n - 1:05d}"]) for s, deps in chain]
    v = views(spark, [chain, ring, chain[:3]])
    began = time.perf_counter()
    metrics = {r.quest_id: r for r in gates.graph_metrics(v).collect()}
    issues = {r.quest_id: (r.code, len(r.detail)) for r in gates.graph(v).collect()}
    assert time.perf_counter() - began < 60
    assert (metrics["q0"].max_depth, metrics["q0"].components, metrics["q0"].n_edges) == (n - 1, 1, n - 1) and metrics["q2"].max_depth == 2
    assert (metrics["q1"].max_depth, metrics["q1"].n_edges) == (0, n)
    assert issues == {"q1": ("CYCLIC_OBJECTIVE_DEPENDENCY", 10 * n + 2)}


def test_cycles_of_long_graphs():
    g = Graph([1, 2, 3, 4, 5, 6], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)])
    assert g.shortest_cycles(3) == [[6], [4, 5], [1, 2, 3]] and g.shortest_cycles(1) == [[1, 2, 3]]
    assert Graph([1, 2], [(1, 2)]).shortest_cycles(3) == []
