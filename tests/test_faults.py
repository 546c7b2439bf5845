"""Detection of all built faults against mutations made by hand."""

from collections import defaultdict

from gatewright.operators import faults
from gatewright.plans import catalog
from gatewright.sources.views import from_tables

SF = "/root/testdata/sf0.001"


def _cyclic(steps):
    edges = {(d, s) for s, d in steps if d != 0}
    while kept := {e for e in edges if any(f[1] == e[0] for f in edges)}:
        if kept == edges:
            return True
        edges = kept
    return False


def test_detection_of_all_faults(spark):
    v = from_tables(spark, SF)
    by = defaultdict(list)
    for r in sorted(v.objective.collect(), key=lambda r: (r.quest_id, r.pos)):
        by[r.quest_id].append((r.step_no, r.dep_no))
    n = v.artifact.count()
    twice = cyclic = 0
    for steps in by.values():
        s0, s1 = steps[0][0], steps[1][0] if len(steps) > 1 else None
        nos = [s0, s0, *[s for s, _ in steps[2:]]] if s1 is not None else [s0]
        twice += len(set(nos)) < len(nos)
        cyclic += _cyclic([(s0, s1), (s1, s0), *steps[2:]] if s1 is not None else steps)
    want = {"unknown_target": len(by), "wrong_giver_type": n, "missing_dependency": len(by), "duplicate_step_id": twice, "cyclic_dependency": cyclic}
    assert set(want) == set(faults.FAULTS)
    got = catalog.QUERIES["q_fault_detection_all_by_fault"](spark, SF).collect()
    assert {r.fault_type: (r.total, r.detected) for r in got} == {f: (n, k) for f, k in want.items()}
    got = {r.validator: r.tp for r in catalog.QUERIES["q_fault_detection_all_by_validator"](spark, SF).collect()}
    graph = want["missing_dependency"] + want["cyclic_dependency"]
    assert got["graph"] == graph and sum(got.values()) == sum(want.values())
