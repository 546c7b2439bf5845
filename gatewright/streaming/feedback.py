"""Streams with memory in tables: feedback of accepted signatures from batch to batch, and resumed ingestion of files.

A micro-batch writes its rows below its own batch id and overwrites what is there, and it reads only what batches of smaller ids have
accepted: a batch that runs again after a failure writes and reads the same as before, so tables hold each batch exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.artifacts import from_texts

ACCEPTED = "quest_id string, ord long, signature string, batch long"
Judge = Callable[[DataFrame], DataFrame]


def written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def accepted_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """quest_id, ord, signature, batch of artifacts that batches before this one accepted; only their folders are read."""
    if not written(spark, f"{path}/accepted"):
        return spark.createDataFrame([], ACCEPTED)
    return spark.read.schema(ACCEPTED).parquet(f"{path}/accepted").where(F.col("batch") < batch)


def told_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """signature, times: what the generator of a batch is told not to repeat; blank signatures are left out."""
    return accepted_before(spark, path, batch).where("signature != ''").groupBy("signature").agg(F.count("*").alias("times"))


def take_batch(rows: DataFrame, batch: int, judge: Judge, path: str) -> None:
    """Judge one batch, tell each artifact how often its signature had been accepted before, and write both tables.

    judge: from the stream's rows to quest_id, ord, signature, passed."""
    spark = rows.sparkSession
    told = told_before(spark, path, batch)
    judged = judge(rows).select("quest_id", F.col("ord").cast("long").alias("ord"), "signature", "passed")
    out = judged.join(told, "signature", "left").select("quest_id", "ord", "signature", "passed", F.coalesce("times", F.lit(0)).cast("long").alias("repeated"))
    out.write.mode("overwrite").parquet(f"{path}/judged/batch={batch}")
    again = spark.read.schema(out.schema).parquet(f"{path}/judged/batch={batch}")
    again.where("passed").select("quest_id", "ord", "signature").write.mode("overwrite").parquet(f"{path}/accepted/batch={batch}")


def feedback(stream: DataFrame, judge: Judge, path: str, checkpoint: str) -> StreamingQuery:
    """Start the batch-by-batch loop over what the stream has now; a restart goes on after the last batch that was finished."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, judge, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """quest_id, ord, signature, passed, repeated, batch of all batches."""
    return spark.read.parquet(f"{path}/judged").withColumn("batch", F.col("batch").cast("long"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> list[int]:
    """Artifacts of the JSON files in folder, as rows (file, ord, json) at out; files that an earlier run has read are not read again.

    Returns how many files each of this run's micro-batches read."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    rows = from_texts(raw.select(F.col("_metadata.file_path").alias("file"), "value")).select("file", "ord", F.to_json("v").alias("json"))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [int(p["numInputRows"]) for p in query.recentProgress if int(p["numInputRows"])]
