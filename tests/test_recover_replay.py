"""JSON in texts against brute force and a clock; recorded responses as a data source."""

import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gatewright.functions import recover, scan
from gatewright.sources import replay, runs

PIECES = ["{", "}", "[", "]", '"', ":", ",", " ", "\n", "1", "-2.5e3", "01", "true", "null", "NaN", "-Infinity", "nul", '"a"', '"title"', "\\", '\\"', "\\u00e9", '{"a":1}', "[1,2]", "text", "é", '"a":']


def brute_value(s, i):
    try:
        return json.JSONDecoder().raw_decode(s, i)
    except ValueError:
        return None


def same(a, b):
    return json.dumps(a) == json.dumps(b)


def test_values_are_those_of_the_decoder():
    r = random.Random(6)
    for _ in range(6000):
        s = "".join(r.choice(PIECES) for _ in range(r.randint(1, 24)))
        values = scan.Values(s)
        for i in range(len(s)):
            want, got = brute_value(s, i), values.at(i)
            if s[i] in '[{"-0123456789tfn':
                assert (want is None) == (got is None), (s, i)
                assert want is None or (same(want[0], got[0]) and want[1] == got[1]), (s, i)


def test_first_value_is_the_first_that_decodes():
    r = random.Random(7)
    for _ in range(3000):
        s = recover.cleaned("".join(r.choice(PIECES) for _ in range(r.randint(1, 20))))
        try:
            want = True, json.loads(s)
        except ValueError:
            want = next(((True, x[0]) for i in range(len(s)) if s[i] in '[{"-0123456789tfn' and (x := brute_value(s, i))), (False, None))
        got = recover.first_value(s)
        assert got[0] == want[0] and same(got[1], want[1]), s


ARTIFACT = {"quest_id": "a", "title": "t", "quest_type": "x", "objectives": [{"step_id": "s"}]}


@pytest.mark.parametrize("text", ['{"a": [' * 170_000, "[" * 1_000_000, '{"' * 500_000, '[1,"' * 250_000, '{"a":{"b":1},' * 80_000, '["' + "x[{" * 330_000, "{" + '"k":[1,2,{"z":"y"}],' * 50_000, "[" * 500_000 + "]" * 500_000])
def test_a_million_characters_in_time(text):
    began = time.perf_counter()
    recover.first_value(text)
    found = recover.listed(text)
    assert time.perf_counter() - began < 8 and isinstance(found, list)  # two scans, on a machine that may be busy


def test_deep_values_count_as_none_and_artifacts_survive_them():
    deep = "[" * 600 + "]" * 600
    assert recover.first_value(deep)[0] and scan.Values(deep).at(0) is None and scan.Values(deep).at(100) is not None
    text = '{"a": [' * 5000 + json.dumps(ARTIFACT) + json.dumps({**ARTIFACT, "quest_id": "b"}) + json.dumps({**ARTIFACT, "title": "other"})[:-3]
    assert recover.listed(text) == [ARTIFACT]
    assert recover.one_object('{"a": [' * 5000) is None and not math.isnan(0.0)


def test_recovery_as_a_table_function(spark):
    texts = [f"Here: {json.dumps([ARTIFACT, {**ARTIFACT, 'title': 'u'}])[:-1]}", json.dumps({"quests": [ARTIFACT, 7]}), "nothing", "", None, '{"a": [' * 5000]
    df = spark.createDataFrame([(i, t, "j") for i, t in enumerate(texts)], "id int, response string, note string").repartition(2)
    want = sorted((i, pos, x["title"]) for i, t in enumerate(texts) for pos, x in enumerate(recover.listed(t)))
    rows = recover.recovered(df, "response").select("id", "pos", F.get_json_object("json", "$.title").alias("title"))
    assert sorted(map(tuple, rows.collect())) == want == [(0, 0, "t"), (0, 1, "u"), (1, 0, "t")]
    assert sorted(r.id for r in recover.recovered(df, "response", recover=False).collect()) == [1]
    recover.register(spark)
    df.createOrReplaceTempView("responses_of_test")
    found = spark.sql("SELECT id, pos, get_json_object(json, '$.title') AS title FROM responses_of_test, LATERAL recover_objects(response, true)")
    assert sorted(map(tuple, found.collect())) == want


RECORDED = {
    1: [{"call": 1, "response": "[1]", "done": True, "done_reason": "stop"}, {"call": 2, "response": "[2", "done": True, "done_reason": "length"}],
    2: [{"call": 1, "response": " ", "done": True}, {"call": 2, "failure": "timeout", "more": 1}],
    12: [{"call": 1, "response": "[3]", "done": False}],
}


@pytest.fixture
def folder(tmp_path):
    for batch, calls in RECORDED.items():
        (tmp_path / f"batch_{batch:02d}.jsonl").write_text("".join(json.dumps(c) + "\n" for c in calls) + "\n")
    (tmp_path / "notes.txt").write_text("no responses")
    return tmp_path


def test_replay_source(spark, folder):
    replay.register(spark)
    df = spark.read.format(replay.NAME).load(str(folder))
    assert df.rdd.getNumPartitions() == 3
    table = [(b, c["call"], c.get("response"), c.get("done"), c.get("done_reason"), c.get("failure")) for b, calls in RECORDED.items() for c in calls]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(table, key=str)
    requests = spark.createDataFrame([(b, c) for b in (1, 2, 3, 12) for c in (1, 2)], "batch int, call int")
    outcomes = lambda responses: sorted(map(str, runs.replayed(requests, responses, ["batch", "call"]).collect()))
    assert outcomes(df) == outcomes(spark.createDataFrame(table, replay.FIELDS))
    assert {re.search("outcome='(\\w+)'", x)[1] for x in outcomes(df)} == {"ok", "truncated", "empty", "timeout", "missing", "unfinished"}


@pytest.mark.parametrize(("condition", "batches"), [("batch = 2", {2}), ("batch in (1, 12)", {1, 12}), ("batch > 1 and batch <= 11", {2}), ("batch >= 2 and call = 1", {2, 12}), ("batch < 1", set()), ("batch = 1 or call = 1", {1, 2, 12})])
def test_filters_on_batch_choose_files(spark, folder, condition, batches):
    replay.register(spark)
    df = spark.read.format(replay.NAME).load(str(folder)).where(condition)
    assert {r.batch for r in df.collect()} == batches
    if " or " not in condition:
        for batch in set(RECORDED) - batches:  # a file that is not chosen is not opened
            (folder / f"batch_{batch:02d}.jsonl").write_text("not JSON")
        assert {r.batch for r in spark.read.format(replay.NAME).load(str(folder)).where(condition).collect()} == batches
