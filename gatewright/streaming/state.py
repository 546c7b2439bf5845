"""State that evolves over a stream of artifacts: what has been used is counted only once an artifact has passed.

Each set has its state: how often signatures, their components and entities have been used, and the ids that are registered. An artifact
that passed is registered unless its id (not a blank one) is registered already. Each artifact is told what its set had used
before it. Artifacts of a set are taken in their order within a micro-batch, and micro-batches in theirs. State is in tables beside the
checkpoint: a micro-batch writes below its own id what it has used and registered, and reads what smaller ids wrote, so one that runs again writes
the same. Counts within a micro-batch are running sums in windows, which spill: neither a set nor a micro-batch has to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import diversity
from ..sources.scratch import keep
from .feedback import written

#: What a stream's rows must have, and what comes out.
JUDGED = "set_id string, ord long, quest_id string, signature string, entities array<string>, passed boolean"
EVOLVED = "set_id string, ord long, quest_id string, signature string, registered boolean, signature_uses long, component_uses long, entity_uses long"
USED, REGISTERED = "set_id string, kind string, x string, n long, batch long", "set_id string, name string, batch long"


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with place: ord; or, where rows of a set share an ord or have none, their number by ord and id."""
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "micro-batch")
    twice = rows.groupBy("set_id", "ord").count().where("count > 1 OR ord IS NULL OR set_id IS NULL").isEmpty()
    by = Window.partitionBy("set_id").orderBy(F.col("ord").asc_nulls_first(), F.coalesce("quest_id", F.lit("")), "row")
    return rows.withColumn("place", F.col("ord") if twice else F.row_number().over(by).cast("long")).drop("row")


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What micro-batches of smaller ids wrote."""
    rows = spark.read.schema(schema).parquet(path) if written(spark, path) else spark.createDataFrame([], schema)
    return rows.where(F.col("batch") < batch).drop("batch")


def take_batch(judged: DataFrame, batch: int, out: str, memory: str) -> None:
    """EVOLVED rows of one micro-batch of JUDGED rows, below out; what it used and registered, below memory."""
    spark = judged.sparkSession
    rows = keep(diversity.registered_first(_in_order(judged), _earlier(spark, f"{memory}/ids", REGISTERED, batch), "place"), "registered")
    names = F.array(*map(F.lit, diversity.KINDS))  # state has the kinds' names
    past = _earlier(spark, f"{memory}/used", USED, batch).withColumn("kind", (F.array_position(names, F.col("kind")) - 1).cast("byte"))
    told = diversity.with_uses(rows, past, "place")
    new = rows.where("registered AND name != ''").select("set_id", "name").distinct()
    uses = [f(rows, "place").where("registered").select("set_id", "kind", "x") for f in (diversity.signed, diversity.used)]
    sums = uses[0].unionByName(uses[1]).groupBy("set_id", "kind", "x").agg(F.count("*").alias("n")).withColumn("kind", F.get(names, F.col("kind").cast("int")))
    for df, path in ((sums, f"{memory}/used"), (new, f"{memory}/ids"), (told, out)):
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_evolving(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 1000) -> None:
    """All files of judged rows (parquet) in folder that are new to the checkpoint, through the state, to parquet at out."""
    rows = spark.readStream.schema(JUDGED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    take = lambda df, batch: take_batch(df, batch, out, f"{checkpoint}/memory")
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
