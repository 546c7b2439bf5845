"""Each stage of the pipeline on the rows that the one before kept."""

import random
from collections import Counter

import corpus_pipeline as p
from gatewright.llm.common import fold
from gatewright.llm.language_id import Classifier, learn
from gatewright.llm.mixing import mix
from gatewright.llm.ngram_join import ngram_join

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "shards":
            assert docs.columns == columns
    before, after = seen["language"]
    assert after.count() > 0.9 * before.count()
    before, after = seen["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in ngram_join(before).collect()}
    before, after = seen["source_mix"]
    assert after.count() == sum(-(-r.taken // max(1, r.size)) for r in mix(before).collect())
    assert seen["shards"][1].count() == after.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def rows_of(spark):
    """Nulls, empty and long texts, ties, repeated ids and rows, columns with clashing names."""
    r = random.Random(9)
    english = ["the", "and", "of", "to", "in", "that", "was", "with", "which", "from"]
    prose = lambda k: " ".join(r.choice(english) + r.choice(["", "ing", "er"]) + r.choice("abcd") for _ in range(k))
    same = prose(60)
    texts = [None, "", "?!", same, same, same + " one more", prose(20_000), *(prose(40) for _ in range(20))]
    data = [(i, t, "en", r.choice(["a", "b", None])) for i, t in enumerate(texts)]
    data += [(3, same, "en", "a"), (4, prose(50), "en", "b"), (None, prose(30), None, None), (None, prose(30), None, "a")]
    fields = "doc_id long, text string, lang string, source string, n_chars long, row long, `_copy` string, `_id` string, `a.b` string, component_id string, label string"
    return spark.createDataFrame([(*x, 1, 2, "c", "i", "d", "g", "l") for x in data], fields)


def bench(spark, tmp_path, docs):
    text = docs.where("doc_id IS NULL AND source IS NULL").first().text
    spark.createDataFrame([(1, text), (2, None), (None, "no such words here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = rows_of(spark).cache()
    sf = bench(spark, tmp_path, docs)
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert {r["a.b"] for r in out.collect()} <= {"d"} and {r["_copy"] for r in out.collect()} <= {"c"}
        if name == "language":
            model = Classifier(learn(docs.where(fold("doc_id", 4) != 2)))
            want = sorted(str(r) for r in docs.collect() if not model.predict(r.text)[3])
            assert sorted(map(str, out.collect())) == want
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            groups = {r.component_id for r in ngram_join(docs).collect() if r.doc_id is not None}
            assert sorted(x for x in ids if x is not None) == sorted(groups) and ids.count(None) == 2
        if name == "benchmark_passages":  # the item's words are all of one document without an id
            assert docs.count() - out.count() == 1 and all(r.source == "a" for r in out.collect() if r.doc_id is None)
        if name == "source_mix":
            taken = {r.doc_id: max(-(-r.taken // max(1, r.size)), 0) for r in mix(docs.where("doc_id > 5")).collect()}
            kept = Counter(r.doc_id for r in stage(spark, docs.where("doc_id > 5"), sf).collect())
            assert kept == {k: n for k, n in taken.items() if n}
        if name == "shards":
            assert out.count() == docs.count() and out.columns[-2:] == ["slot", "shard"]
