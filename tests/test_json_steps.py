"""Objectives of JSON artifacts read in one go, against element by element."""

import json

from pyspark.sql import functions as F

from gatewright.functions.text import clean, step_name
from gatewright.operators import repair
from gatewright.plans import catalog, json_catalog  # noqa: F401
from gatewright.sources.artifacts import at, numbered


def test_odd_objectives_as_element_by_element(spark):
    odd = [{"objectives": [1, None, "x", {"action": " TALK ", "target": {"a": [1]}, "success_condition": 2.5}, {"action": None, "target": True}, [], {}]}]
    odd += [{"objectives": x} for x in ("no", {"a": 1}, [], None)] + [{}]
    rows = spark.createDataFrame([(str(i), i, json.dumps(x)) for i, x in enumerate(odd)], "quest_id string, ord long, t string").select("quest_id", "ord", F.parse_json("t").alias("v"))
    step = lambda s: F.struct(F.lower(clean(at(s["v"], "action"))).alias("action"), clean(at(s["v"], "target")).alias("target"), clean(at(s["v"], "success_condition")).alias("success"))
    want = [r.x for r in rows.orderBy("ord").select(F.transform(numbered(at(F.col("v"), "objectives")), step).alias("x")).collect()]
    assert [r.p.steps for r in repair.parsed(rows, {}).orderBy("ord").collect()] == want


def test_step_names(spark):
    n = [0, 7, 12, 999, 1000, 12345, -1]
    assert [r.s for r in spark.createDataFrame([(x,) for x in n], "n long").select(step_name(F.col("n")).alias("s")).collect()] == [f"step_{x:03d}" for x in n]


def test_direct_actions_reads_each_artifact_once(spark):
    plan = catalog.QUERIES["q_direct_actions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_variant_object") == 1 and "map_from_entries" not in plan
