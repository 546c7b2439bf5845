"""Recorded model responses and run folders as sources: nothing here calls a model."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .artifacts import at, elements, is_object, kind

#: The names of configurations, and the modulus of request seeds.
CONFIGURATIONS, SEEDS = ("C1", "C2", "C3", "C4", "C5"), 2147483647


def request_seeds(requests: DataFrame, base: int | None, order: list[str], reset: list[str] | None = None) -> DataFrame:
    """requests with seed: (base + its index) mod SEEDS, the index from 0 in order and anew for each value of reset; null without a base."""
    if base is None:
        return requests.withColumn("seed", F.lit(None).cast("long"))
    w = Window.partitionBy(*(reset or [F.lit(0)])).orderBy(*order)
    return requests.withColumn("seed", F.pmod(F.lit(base).cast("long") + F.row_number().over(w) - 1, F.lit(SEEDS).cast("long")))


def replayed(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """requests with their recorded response and outcome.

    responses: keys, response, done, done_reason, failure (null, or the kind of error that was recorded). A response cut at its length limit is kept;
    an unfinished one, an empty one and a missing one are outcomes of their own, without a response."""
    r = requests.join(responses, keys, "left")
    known = F.coalesce(F.col("done").cast("string"), "failure", "response").isNotNull()
    outcome = (
        F.when(~known, "missing")
        .when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.coalesce("done_reason", F.lit("")) == "length", "truncated")
        .when(~F.coalesce("done", F.lit(False)), "unfinished")
        .when(F.trim(F.coalesce("response", F.lit(""))) == "", "empty")
        .otherwise("ok")
    )
    return r.select(*requests.columns, outcome.alias("outcome"), F.when(outcome.isin("ok", "truncated"), F.col("response")).alias("response"))


def finished_batches(requested: DataFrame, files: DataFrame) -> DataFrame:
    """requested (batch, n) with done: whether files (batch, v: the whole file's value) has a list of n objects for it."""
    v = F.col("v")
    whole = F.coalesce((kind(v) == "ARRAY") & F.forall(elements(v), is_object), F.lit(False))
    good = files.where(whole).select("batch", F.size(elements(v)).cast("long").alias("n")).distinct().withColumn("done", F.lit(True))
    return requested.join(good, ["batch", "n"], "left").select("batch", "n", F.coalesce("done", F.lit(False)).alias("done"))


def resolved(path: str | None, root: str, default: str) -> str:
    """The default without a path; else the path, below root unless it is absolute or has a scheme."""
    if not path:
        return os.path.join(root, default)
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_present(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists."""
    tried = list(paths)
    for path in tried:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(tried))


def run_files(spark: SparkSession, runs: dict[str, str], required: Iterable[str]) -> DataFrame:
    """run, name, v: the values of the required files of each run's folder; an error names what is missing."""
    names = list(required)
    missing = [f"{d}/{n}" for d in runs.values() for n in names if not _exists(spark, f"{d}/{n}")]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    parts = [spark.read.text([f"{d}/{n}" for n in names], wholetext=True).select(F.lit(run).alias("run"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.try_parse_json("value").alias("v")) for run, d in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def configurations(comparison: DataFrame) -> DataFrame:
    """run, configuration, v of comparison files (run, v): those at the key configurations, else the known names at the top."""
    listed = at(F.col("v"), "configurations")
    own = F.when(is_object(listed), F.try_variant_get(listed, "$", "map<string,variant>"))
    top = F.map_filter(F.try_variant_get(F.col("v"), "$", "map<string,variant>"), lambda k, _: k.isin(list(CONFIGURATIONS)))
    return comparison.select("run", F.explode(F.coalesce(own, top)).alias("configuration", "v"))


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def canonical(v: Column, *without: str) -> Column:
    """The object's JSON with its keys in order, without some: equal for artifacts that differ in these only."""
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(list(without)))
    return F.to_json(F.to_variant_object(rest))


def fingerprint(v: Column) -> Column:
    """A digest of the artifact without its id."""
    return F.sha2(canonical(v, "quest_id").cast("binary"), 256)
