"""Mutants judged in their artifact's row against all gates over all mutants."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gatewright.operators import faults, gates
from gatewright.plans import catalog
from gatewright.sources.views import Views, compat_table

SF = "/root/testdata/sf0.001"


def views(spark, more=()):
    steps = {1: [(1, 0), (2, 1)], 2: [(1, 1)], 3: [(1, 0), (1, 0), (2, 7)], 4: [], 5: [(2, 3), (3, 2), (4, 0)], 6: [(5, 0)]}
    rows = [(q, i, s, "RO", "part_1", d) for q, xs in steps.items() for i, (s, d) in enumerate(xs)]
    objective = spark.createDataFrame(rows, "quest_id long, pos long, step_no long, action string, target string, dep_no long")
    artifact = spark.createDataFrame([(q, "k", "cust_1", "nation_2", 0, q) for q in steps], "quest_id long, quest_type string, giver string, start string, set_id long, ord long")
    reward = spark.createDataFrame([], "quest_id long, pos long, type string, value string")
    entity = spark.createDataFrame([("part_1", "small"), ("cust_1", "customer"), ("nation_1", "nation"), ("nation_2", "nation"), *more], "entity_id string, entity_type string")
    return Views(artifact, objective, reward, entity, compat_table(spark, {"RO": ("small",)}), "customer", "nation", ("small",))


def counted(df):
    return {r.fault_type: (r.total, r.detected) for r in df.collect()}


@pytest.mark.parametrize("more", [(), ((faults.NO_ENTITY, "small"),)])
def test_caught_is_detection_of_the_mutants_issues(spark, more):
    v = views(spark, more)
    wrong = F.lit("nation_1")
    m, ids = faults.mutants(v, wrong)
    assert counted(faults.caught(v, wrong)) == counted(faults.detection(ids, gates.structural(m), "fault_type"))
    known = replace(v, entity=v.entity.where("entity_id != 'nation_1'"))  # an unknown giver has another code
    assert counted(faults.caught(known, wrong))["wrong_giver_type"] == (6, 0)


@pytest.mark.parametrize("name", ["q_fault_detection_by_fault", "q_fault_detection_by_validator", "q_fault_detection_all_by_fault", "q_fault_detection_all_by_validator"])
def test_steps_are_gathered_once(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Window [") == 1 and "Join LeftOuter" not in plan
