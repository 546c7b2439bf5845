"""Codes of changes without the changes, against those of the whole repair."""

from pyspark.sql import functions as F
from test_json_operators import BAD
from test_repair import ENTITY, GENERIC, GOOD, RESCUE, SCHEMA, artifacts

from gatewright.operators import repair
from gatewright.plans import catalog, json_catalog  # noqa: F401


def test_codes_are_those_of_the_changes(spark):
    entity = spark.createDataFrame(ENTITY, "entity_id string, entity_type string")
    rows = artifacts(spark, GOOD, BAD, GENERIC, RESCUE, {"quest_id": "none"})
    all_ = [tuple(r) for r in repair.repair(rows, entity, SCHEMA).select("quest_id", F.explode("changes.code")).collect()]
    for codes in ({c for _, c in all_}, {"NORMALIZE_TAGS", "REPAIR_GIVER_NPC"}, {"NO_SUCH_CODE"}):
        got = sorted(tuple(r) for r in repair.change_codes(rows, entity, SCHEMA, tuple(codes)).collect())
        assert got == sorted(x for x in all_ if x[1] in codes)


def test_other_rules_are_not_evaluated(spark):
    plan = catalog.QUERIES["q_repair_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "new_objectives" not in plan and "new_preconditions" not in plan and plan.count("NORMALIZE_DESIGN_NOTES") == 2  # where it is made, and in the filter
