"""Graphs by bits of a batch against walks of one graph each, at and beyond the bits of a word."""

import random

import pyarrow as pa
import pytest

from gatewright.operators import array_graphs, gates
from gatewright.operators.long_graphs import Graph
from gatewright.plans import catalog, front_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def graphs(kind):
    r = random.Random(21)
    out = [[], None, [(1, 1)], [(i, i + 1) for i in range(63)], [(i, (i + 1) % 64) for i in range(64)], [(i, (i + 1) % 65) for i in range(65)], [(i, i + 1) for i in range(90)]]
    out += [sorted({(r.randint(1, 7), r.randint(1, 7)) for _ in range(r.randint(0, 9))}) for _ in range(300)]
    return [None if g is None else [(kind(a), kind(b)) for a, b in g] for g in out]


@pytest.mark.parametrize("kind", [int, lambda x: f"s{x}"])
def test_batches_against_walks(kind):
    want = graphs(kind)
    type_ = pa.string() if isinstance(kind(1), str) else pa.int64()
    edges = pa.array([None if g is None else [{"src": a, "dst": b} for a, b in g] for g in want], pa.list_(pa.struct([("src", type_), ("dst", type_)])))
    for at in (0, 3):  # a part of an array has its own offsets
        cyclic, cycles, lost = array_graphs.cyclic_rows(edges[at:]), array_graphs.cycle_rows(edges[at:], 3), array_graphs.lost_rows(edges[at:])
        for i, g in enumerate(want[at:]):
            w = Graph(sorted({x for e in g or [] for x in e}), g or [])
            assert cyclic[i] == w.cyclic() == bool(cycles[i])
            seen = w.reached(w.roots())
            assert lost[i] == [x for x in w.nodes if x not in seen]
            links = {x: sorted(ys) for x, ys in w.after.items()}
            assert cycles[i] == [list(c) for c in array_graphs.simple_cycles(links, 3)]


@pytest.mark.parametrize("name", ["q_graph_unreachable", "q_graph_cycle_text", "q_graph_cycles", "q_combined_reports", "q_evolving_diversity"])
def test_no_walk_by_array_expressions(spark, name):
    assert "aggregate(sequence" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_codes_asked_for_are_those_of_the_whole_gate(spark):
    from gatewright.sources.views import from_tables

    v = from_tables(spark, SF)
    every = sorted(map(str, gates.graph(v).collect()))
    apart = [str(r) for c in ("MISSING_STEP_DEPENDENCY", *gates.WHOLE) for r in gates.graph(v, (c,)).collect()]
    assert sorted(apart) == every and every


def test_published_reports_gather_issues_once(spark):
    plan = catalog.QUERIES["q_combined_reports"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
