"""Relational views of artifacts: the same columns whether they come from artifact JSON or from business tables.

artifact(quest_id, quest_type, giver, start, set_id, ord), objective(quest_id, pos, step_no, action, target, dep_no; from tables also
place, whose order is that of pos: who needs the order only spares the numbering), reward(quest_id, pos, type, value), dependency(quest_id, pos, step_no, dep_no, explicit; where it is not given, each
objective's own dep_no counts), unlisted(quest_id, pos: objectives whose dependencies are given, but not as a list), entity(entity_id, entity_type), action_compat(action, entity_type).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The actions' compatible target types in the table mapping.
TABLE_COMPAT = {"RO": ("small", "medium", "large"), "RF": ("large", "promo"), "AF": ("economy", "standard", "small"), "AO": ("promo", "medium"), "NO": ("standard", "economy", "large"), "NF": ("small", "promo", "standard")}


@dataclass(frozen=True)
class Views:
    artifact: DataFrame
    objective: DataFrame
    reward: DataFrame
    entity: DataFrame
    compat: DataFrame
    giver_type: str
    start_type: str
    item_types: tuple[str, ...]
    dependency: DataFrame | None = None
    unlisted: DataFrame | None = None


def compat_table(spark: SparkSession, compat: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(a, t) for a, ts in compat.items() for t in ts], "action string, entity_type string")


def from_tables(spark: SparkSession, sf_dir: str) -> Views:
    """Orders are artifacts, lineitems their objectives; parts, customers and nations the catalog."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = read("orders")
    artifact = o.select(F.col("o_orderkey").alias("quest_id"), F.col("o_orderpriority").alias("quest_type"), cat("cust_", "o_custkey").alias("giver"), F.concat(F.lit("nation_"), (F.col("o_custkey") % 27).cast("string")).alias("start"), (F.col("o_orderkey") % 3).alias("set_id"), F.col("o_orderkey").alias("ord"))
    by = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = Window.partitionBy("l_orderkey").orderBy(*by)
    objective = read("lineitem").select(F.col("l_orderkey").alias("quest_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("l_linenumber").cast("long").alias("step_no"), F.concat("l_returnflag", "l_linestatus").alias("action"), cat("part_", "l_partkey").alias("target"), (F.col("l_suppkey") % 8).alias("dep_no"), F.struct(*by).alias("place"))
    value = F.when(F.col("o_orderkey") % 7 == 0, cat("cust_", "o_custkey")).otherwise(F.concat(F.lit("part_"), (F.col("o_orderkey") % 2500).cast("string")))
    reward = o.select(F.col("o_orderkey").alias("quest_id"), F.lit(0).cast("long").alias("pos"), F.when(F.col("o_orderstatus") == "F", "item").otherwise("currency").alias("type"), value.alias("value"))
    parts = read("part").where("p_size <= 45").select(cat("part_", "p_partkey").alias("entity_id"), F.lower("p_type").alias("entity_type"))
    customers = read("customer").where("c_acctbal >= 0").select(cat("cust_", "c_custkey").alias("entity_id"), F.lit("customer").alias("entity_type"))
    nations = read("nation").select(cat("nation_", "n_nationkey").alias("entity_id"), F.lit("nation").alias("entity_type"))
    types = tuple(sorted({t for ts in TABLE_COMPAT.values() for t in ts}))
    return Views(artifact, objective, reward, parts.unionByName(customers).unionByName(nations), compat_table(spark, TABLE_COMPAT), "customer", "nation", types)
