"""Connected components over written tables: minimum labels with pointer jumping; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(links: DataFrame) -> DataFrame:
    """v, label (the smallest v reachable) for each end of links (u, v: long)."""
    n = 2 * links.count()
    both = stored(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "links", n)
    labels = table = stored(both.groupBy(F.col("u").alias("v")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels", n)
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["v"] == near["u"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = stored(least.join(to, "label").select("v", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("moved")), "labels", n)
        drop(table)
        table, labels = new, new.select("v", "label")
        if new.where("moved").isEmpty():
            drop(both)
            return labels
