"""Gates and rates over streams of artifacts (an addition: a batch of files works the same way).

A gate reads one artifact at a time, so it needs no state. First-wins removal of repeated ids keeps ids for as long as the
watermark says; rates are of event-time windows, and late rows within the watermark count.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.schema_gate import issues_of


def first_wins(artifacts: DataFrame, id_: str, time: str, late: str) -> DataFrame:
    """Rows whose id did not come before, within the watermark."""
    return artifacts.withWatermark(time, late).dropDuplicatesWithinWatermark([id_])


def judged(artifacts: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """artifacts (v) with errors, the number of schema issues, and passed."""
    errors = F.size(issues_of(F.col("v"), schema))
    return artifacts.withColumn("errors", errors).withColumn("passed", F.col("errors") == 0)


def acceptance_by_window(rows: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """start, end, artifacts, passed, rate for each window of rows with a boolean passed."""
    counts = rows.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("artifacts"), F.count_if("passed").alias("passed"))
    return counts.select("window.start", "window.end", "artifacts", "passed", (F.col("passed") / F.col("artifacts")).alias("rate"))
