"""Streams against batches: state across restarts, feedback that runs again, resumed ingestion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gatewright.operators import diversity
from gatewright.streaming import feedback, state

PARTS = ("talk:npc", "visit:location", "collect:item")


def judged_rows(n, seed):
    r = random.Random(seed)
    some = lambda: " -> ".join(r.choice(PARTS) for _ in range(r.randint(0, 2)))
    ids = lambda i: r.choice([f"q{i}", f"q{i % 7}", "", " ", None])
    return [(str(i % 2), i, ids(i), r.choice([some(), None]) if i % 9 == 0 else some(), [r.choice("abc") for _ in range(r.randint(0, 3))], r.random() < 0.6) for i in range(n)]


def brute(rows):
    out, state_of = [], {}
    for set_id, ord_, quest, signature, entities, passed in rows:
        s = state_of.setdefault(set_id, {"sig": {}, "part": {}, "ent": {}, "ids": set()})
        signature, name = signature or "", (quest or "").strip()
        new = passed and not (name and name in s["ids"])
        parts = signature.split(" -> ") if signature else []
        out.append((set_id, ord_, quest, signature, new, s["sig"].get(signature, 0), sum(s["part"].get(p, 0) for p in set(parts)), sum(s["ent"].get(e, 0) for e in set(entities))))
        if new:
            s["sig"][signature] = s["sig"].get(signature, 0) + 1
            for k, xs in (("part", parts), ("ent", entities)):
                for x in xs:
                    s[k][x] = s[k].get(x, 0) + 1
            s["ids"] |= {name} - {""}
    return sorted(out, key=lambda x: x[1])


COLUMNS = [c.split()[0] for c in state.EVOLVED.split(", ")]


def evolved(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=lambda x: x[1])


def test_state_across_restarts_is_the_batch(spark, tmp_path):
    rows = judged_rows(60, 1)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for lo, hi in ((0, 25), (25, 40), (40, 60)):  # each run is a query of its own that goes on from the checkpoint
        spark.createDataFrame(rows[lo:hi], state.JUDGED).coalesce(1).write.mode("append").parquet(folder)
        state.run_evolving(spark, folder, out, checkpoint)
    want = brute(rows)
    assert evolved(spark.read.parquet(out)) == want
    assert evolved(diversity.evolving(spark.createDataFrame(rows, state.JUDGED))) == want
    assert any(x[5] for x in want) and any(x[4] != r[5] for x, r in zip(want, rows))


def test_state_of_rows_with_shared_or_missing_places(spark, tmp_path):
    rows = [("s", None, "b", "talk:npc", ["e"], True), ("s", None, "a", "talk:npc", ["e"], True), ("s", 1, "d", "talk:npc", None, True), ("s", 1, "c", "talk:npc", ["e"], None)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows, state.JUDGED).coalesce(1).write.parquet(folder)
    state.run_evolving(spark, folder, out, checkpoint)
    found = {r.quest_id: (r.ord, r.registered, r.signature_uses, r.entity_uses) for r in spark.read.parquet(out).collect()}
    assert found == {"a": (None, True, 0, 0), "b": (None, True, 1, 1), "c": (1, False, 2, 2), "d": (1, True, 2, 0)}
    # A micro-batch that runs again writes what it wrote, and none of its rows goes through Python.
    state.take_batch(spark.read.schema(state.JUDGED).parquet(folder), 0, out, f"{checkpoint}/memory")
    assert found == {r.quest_id: (r.ord, r.registered, r.signature_uses, r.entity_uses) for r in spark.read.parquet(out).collect()}


def test_evolving_of_nothing(spark):
    assert diversity.evolving(spark.createDataFrame([], state.JUDGED)).isEmpty()


BATCH = "quest_id string, ord long, signature string, good boolean"


def judge(df):
    return df.withColumnRenamed("good", "passed")


@pytest.fixture
def batches():
    one = [("a", 1, "x", True), ("b", 2, "y", False), ("c", 3, "", True)]
    two = [("d", 4, "x", True), ("e", 5, "y", True), ("f", 6, "", True)]
    three = [("g", 7, "x", True), ("h", 8, "y", False)]
    return [one, two, three]


def rows_of(spark, path):
    return sorted(map(tuple, feedback.results(spark, path).select("batch", "quest_id", "passed", "repeated").collect()))


def test_feedback_from_batch_to_batch(spark, tmp_path, batches):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "tables", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(folder)
        feedback.feedback(spark.readStream.schema(BATCH).parquet(folder), judge, path, checkpoint).awaitTermination()
    want = [(0, "a", True, 0), (0, "b", False, 0), (0, "c", True, 0), (1, "d", True, 1), (1, "e", True, 0), (1, "f", True, 0), (2, "g", True, 2), (2, "h", False, 1)]
    assert rows_of(spark, path) == want
    # A batch that runs again, even after later ones, changes nothing.
    for n in (1, 2, 0):
        feedback.take_batch(spark.createDataFrame(batches[n], BATCH), n, judge, path)
        assert rows_of(spark, path) == want
    assert {(r.signature, r.times) for r in feedback.told_before(spark, path, 2).collect()} == {("x", 2), ("y", 1)}


def test_ingestion_goes_on_where_it_ended(spark, tmp_path):
    folder, out, checkpoint = (tmp_path / x for x in ("in", "out", "checkpoint"))
    folder.mkdir()
    for n in range(3):
        (folder / f"batch_{n}.json").write_text(json.dumps([{"quest_id": f"q{n}{i}"} for i in range(n + 1)]))
    assert feedback.ingest(spark, str(folder), str(out), str(checkpoint), files_per_trigger=2) == [2, 1]
    (folder / "batch_3.json").write_text('{"quests": [{"quest_id": "late"}, 7]}')
    (folder / "broken.json").write_text('{"quests": [')
    assert feedback.ingest(spark, str(folder), str(out), str(checkpoint)) == [2]
    assert feedback.ingest(spark, str(folder), str(out), str(checkpoint)) == []
    found = spark.read.parquet(str(out))
    assert sorted(r.json for r in found.select(F.col("json")).collect()) == sorted([f'{{"quest_id":"q{n}{i}"}}' for n in range(3) for i in range(n + 1)] + ['{"quest_id":"late"}', "7"])
