"""Sinks: JSON, text, CSV, routed artifacts and raw responses; all overwrite and are written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .experiments import numeric_summary, run_table
from .gates import union


def save_json(artifacts: DataFrame, path: str) -> None:
    """A line of JSON for each row's v, or for the whole row where there is no v."""
    c = F.to_json("v") if "v" in artifacts.columns else F.to_json(F.struct("*"))
    artifacts.select(c.alias("value")).write.mode("overwrite").text(path)


def save_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def save_csv(frames: list[DataFrame], path: str) -> bool:
    """All rows with a header of all columns in first-seen order; nothing is written, and False returned, if there are none."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    kinds = {c: t for f in reversed(frames) for c, t in f.dtypes}
    wide = [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]) for f in frames]
    if not frames or (rows := union(wide)).isEmpty():
        return False
    rows.write.mode("overwrite").option("header", True).csv(path)
    return True


def save_routed(records: DataFrame, path: str) -> None:
    """Artifacts as they end in folders status=accepted and status=rejected, and the records beside them."""
    status = F.when(F.col("passed"), "accepted").otherwise("rejected")
    records.select(status.alias("status"), F.to_json("r").alias("value")).write.mode("overwrite").partitionBy("status").text(f"{path}/artifacts")
    records.drop("v", "r").write.mode("overwrite").json(f"{path}/records")


def save_raw(responses: DataFrame, path: str, unit: str) -> None:
    """Raw responses in folders by name: '<id>_attempt_<n>' or 'batch_<nn>'. responses: unit, attempt, response."""
    name = F.format_string("batch_%02d", F.col("batch").cast("int")) if unit == "batch" else F.concat_ws("_attempt_", F.col(unit).cast("string"), F.col("attempt").cast("string"))
    responses.select(name.alias("name"), F.col("response").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def save_aggregate(path: str, runs: DataFrame, configurations: DataFrame, diversity: DataFrame, metrics: dict[str, list[str]]) -> None:
    """The results of several runs: two CSV tables with fixed headers (run, run_seed, configuration, and the metrics of each table) and a summary.

    runs: run, run_seed, c2_hash, c5_hash; configurations and diversity: run, configuration, metric, value. A metric that a run lacks is empty, and
    so is a table without rows but for its header. The summary is one JSON line: runs, seeds, whether seeds and files are all different, and
    count, mean, standard deviation, least and most of each metric of each configuration."""
    parts = {}
    for name, values in (("configuration", configurations), ("diversity", diversity)):
        wide = run_table(values, metrics[name]).join(runs.select("run", "run_seed"), "run").select("run", "run_seed", "configuration", *metrics[name])
        wide.coalesce(1).sortWithinPartitions("run", "configuration").write.mode("overwrite").option("header", True).csv(f"{path}/{name}_metrics")  # a row for each run and configuration
        known = values.where(F.col("metric").isin(metrics[name])).withColumn("ord", F.col("run"))
        stats = numeric_summary(known, ["configuration", "metric"]).drop("values")
        parts[name] = stats.agg(F.array_sort(F.collect_list(F.struct(*stats.columns))).alias(f"{name}_metrics"))
    unique = lambda c: (F.count_distinct(c) == F.count(c)).alias(f"all_{c}_unique")
    told = runs.agg(F.count("*").alias("run_count"), F.array_sort(F.collect_list(F.struct("run", "run_seed", "c2_hash", "c5_hash"))).alias("records"), unique("run_seed"), unique("c2_hash"), unique("c5_hash"))
    told.crossJoin(parts["configuration"]).crossJoin(parts["diversity"]).coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # one row each


def console(summary: DataFrame, by: DataFrame, labels: dict[str, str]) -> str:
    """A summary as lines of text: labels with the one row's values (rates as percentages), and a line for each row of by (validator, passed,
    failed, errors, warnings), which are as many as there are gates."""
    row = summary.first()
    shown = lambda x: f"{x:.2%}" if isinstance(x, float) else str(x)
    lines = [f"{label}: {shown(row[c])}" for c, label in labels.items()]
    return "\n".join(lines + [f"- {r.validator}: {r.passed} PASS, {r.failed} FAIL, {r.errors} errors, {r.warnings} warnings" for r in by.orderBy("validator").collect()])
