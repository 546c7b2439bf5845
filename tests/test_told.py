"""What batches are told, as digests made in one pass, against the lists."""

import hashlib
import random

from pyspark.sql import functions as F

from gatewright.operators import experiments, generation, json_faults


def test_digests_are_those_of_the_lists(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([1, 2, 5, 70, None]), r.choice([*range(40), None]), r.choice(["", "a", "ab", "a b", "ã -> é", None])) for _ in range(400)]
    accepted = spark.createDataFrame(rows, "batch long, ord long, signature string").repartition(5)
    batches = spark.createDataFrame([(b,) for b in (1, 2, 3, 70, 99, 2)], "batch long")
    lists = {x.batch: x.signatures for x in generation.forbidden_signatures(accepted, batches.unionByName(accepted.select("batch"))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        told = generation.told_digests(accepted, batches.unionByName(accepted.select("batch"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {x.batch: (x.n, x.digest) for x in told} == {b: (len(xs), hashlib.md5("|".join(xs).encode()).hexdigest()) for b, xs in lists.items()}
    assert "collect_list" not in generation.told_digests(accepted, batches)._jdf.queryExecution().toString()


def test_each_gate_judges_mutants_whose_code_it_may_raise(spark):
    seen = {}
    none = "quest_id string, validator string, code string, severity string, path string, detail string"

    def gate(name):
        def judge(rows):
            seen[name] = {x.quest_id for x in rows.collect()}
            return spark.createDataFrame([], none)

        return judge

    app = experiments.Application(None, {}, {n: gate(n) for n in (*experiments.CODES, "own")})
    made = spark.createDataFrame([(f, c) for f, c in json_faults.FAULTS.items()], "quest_id string, expected_code string").withColumn("v", F.parse_json(F.lit("{}")))
    app.expected(made).collect()
    assert seen.pop("own") == set(json_faults.FAULTS)
    assert sum(map(len, seen.values())) == len(json_faults.FAULTS) and all(seen.values())
