"""A training-data pipeline over documents: language, near duplicates, benchmark passages, mix, shards.

Each stage works on all rows that the one before kept, and is written and read again.

Defined results, of every stage: null and empty texts have no language, so the first stage drops them; later stages keep
them. Rows that repeat a doc_id are one document to near_duplicates, which keeps one of them; benchmark_passages treats
each row by its text, source_mix by its id, shards by its id. A null doc_id is no reason to drop a row: near_duplicates keeps all such rows,
whatever their texts. Ties are settled by smallest ids and code-point order, so reruns agree. Very long texts are read whole. Other
columns, whatever their names, pass through unchanged; shards adds slot and shard. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import BATCH_ROWS, TEXTS_PER_BATCH, documents, fold, scratch, stored
from gatewright.llm.decontamination import find_contamination, is_contaminated
from gatewright.llm.language_id import keep_identified, learn
from gatewright.llm.mixing import mixed_copies
from gatewright.llm.ngram_join import MAX_BROADCAST_IDS, ngram_join, with_few
from gatewright.llm.sharding import place


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart; learns from three quarters of the labelled rows.

    The session's batches to Python workers are set to TEXTS_PER_BATCH texts: the stage is written after it returns."""
    spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))
    return keep_identified(docs, learn(docs.where(fold("doc_id", 4) != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group that links of similarity 0.75 or more connect.

    Of rows that repeat a doc_id, the one stays that comes first as JSON; each row without a doc_id stays."""
    groups = stored(ngram_join(docs).select("doc_id", "component_id"), "groups")
    kept = with_few(docs, groups.where("component_id != doc_id").select("doc_id").distinct(), "left_anti")
    repeated = stored(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = with_few(kept, repeated, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return with_few(kept, repeated, "left_anti").unionByName(one)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    A text alone decides, so rows are found and dropped by a 64-bit hash of their texts, with or without a doc_id."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = find_contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stored(found.where(is_contaminated()).select("doc_id").distinct(), "contaminated")
    few = bad.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, key == bad["doc_id"], "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: some not at all, some twice."""
    return mixed_copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the slot and the shard of each."""
    return place(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("source_mix", source_mix), ("shards", shards)]
#: Compression, components and a schedule are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
