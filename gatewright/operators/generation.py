"""Batches of artifacts from recorded responses, with quotas, numbering and diagnostics; what later batches are told of earlier ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.recover import extract_artifacts
from ..sources.artifacts import kind

MOST_CALLS = 8
#: Batch numbers whose running lists are made together.
BATCHES = 64
#: Between signatures of a digest.
SEPARATOR = "|"
RETRY = "Return exactly {0} new quest(s)."


def generated(requests: DataFrame, responses: DataFrame, mode: str, model: str, most_calls: int = MOST_CALLS) -> tuple[DataFrame, DataFrame]:
    """Artifacts (quest_id, ord, batch, v) and diagnostics (batch, requested, returned, call_count, collected, shortfall,
    completed) of requests (batch, n) over responses (batch, call from 1, response).

    Calls are taken in order until a batch has n artifacts, most_calls at most; the last call gives only what is missing. A batch that stays short
    gives no artifacts. Artifacts are numbered over all calls, and their generation fields are set."""
    found = responses.where(F.col("call") <= most_calls).select("batch", "call", extract_artifacts("response").alias("xs"))
    so_far = Window.partitionBy("batch").orderBy("call").rowsBetween(Window.unboundedPreceding, -1)
    calls = requests.join(found.withColumn("k", F.size("xs")), "batch").withColumn("before", F.coalesce(F.sum("k").over(so_far), F.lit(0)))
    used = calls.where(F.col("before") < F.col("n"))
    stats = used.groupBy("batch").agg(F.count("*").alias("call_count"), F.transform(F.array_sort(F.collect_list(F.struct("call", "k"))), lambda s: s["k"]).alias("returned"), F.sum("k").alias("all"))
    zero = F.lit(0).cast("long")
    diagnostics = requests.join(stats, "batch", "left").select("batch", F.col("n").cast("long").alias("requested"), F.coalesce("returned", F.expr("cast(array() as array<int>)")).alias("returned"), F.coalesce("call_count", zero).alias("call_count"), F.least(F.coalesce("all", zero), "n").alias("collected"))
    diagnostics = diagnostics.withColumn("shortfall", F.col("requested") - F.col("collected")).withColumn("completed", F.col("shortfall") == 0)
    each = used.select("batch", "n", "before", F.posexplode("xs").alias("pos", "text")).withColumn("i", (F.col("before") + F.col("pos") + 1).cast("long")).where(F.col("i") <= F.col("n"))
    whole = each.join(diagnostics.where("completed").select("batch"), "batch", "left_semi")
    name = F.format_string("batch_%02d_quest_%03d", F.col("batch"), F.col("i"))
    overall = (F.col("batch") - 1) * F.col("n") + F.col("i")
    own = {"quest_id": name, "generation_batch": F.col("batch").cast("long"), "generation_index_in_batch": F.col("i"), "generation_global_index": overall.cast("long"), "generation_mode": F.lit(mode), "generation_model": F.lit(model)}
    rest = F.map_filter(F.try_variant_get(F.parse_json("text"), "$", "map<string,variant>"), lambda k, _: ~k.isin(list(own)))
    v = F.to_variant_object(F.map_concat(rest, F.create_map(*[x for k, c in own.items() for x in (F.lit(k), c.cast("variant"))])))
    return whole.select(name.alias("quest_id"), overall.cast("long").alias("ord"), F.col("batch").cast("long").alias("batch"), v.alias("v")), diagnostics


def generation_summary(diagnostics: DataFrame) -> DataFrame:
    """One row: batches, calls, requested, collected and shortfall in all."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return diagnostics.agg(F.count("*").alias("batches"), total("call_count").alias("calls"), total("requested").alias("requested"), total("collected").alias("collected"), total("shortfall").alias("shortfall"))


def forbidden_signatures(accepted: DataFrame, batches: DataFrame) -> DataFrame:
    """batch, signatures: those (not empty) of artifacts accepted in earlier batches, in order. accepted: batch, ord, signature.

    Running lists are made in two steps, within ranges of BATCHES batch numbers, and of whole ranges: no task holds all batches but
    those that the list itself, which grows with each batch, asks for."""
    nothing = F.expr("cast(array() as array<string>)")
    in_order = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    own = accepted.where("signature != ''").groupBy("batch").agg(F.transform(in_order("ord", "signature"), lambda s: s["signature"]).alias("own"))
    rows = batches.select("batch").distinct().join(own, "batch", "left").select("batch", F.expr(f"batch div {BATCHES}").alias("range"), F.coalesce("own", nothing).alias("own"))
    before = Window.partitionBy("range").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.select("batch", "range", F.flatten(F.collect_list("own").over(before)).alias("within"))
    ranges = rows.groupBy("range").agg(F.flatten(F.transform(in_order("batch", "own"), lambda s: s["own"])).alias("all"))
    numbers = ranges.agg(F.collect_set("range").alias("numbers"))  # one row: a number for BATCHES batches each
    pairs = ranges.select("range").crossJoin(F.broadcast(numbers)).select("range", F.explode(F.filter("numbers", lambda n: n < F.col("range"))).alias("earlier"))
    told = pairs.join(ranges.select(F.col("range").alias("earlier"), "all"), "earlier").groupBy("range").agg(F.flatten(F.transform(in_order("earlier", "all"), lambda s: s["all"])).alias("told"))
    return within.join(told, "range", "left").select("batch", F.concat(F.coalesce("told", nothing), "within").alias("signatures"))


def _pieces(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of one batch in a table of rows in order: its first ord and signature, the joined text, and how many they are."""
    for t in tables:
        batch = t["batch"].to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]) if len(batch) else []
        end = [*begin[1:], len(batch)]
        texts = [SEPARATOR.join(t["signature"][i:j].to_pylist()) for i, j in zip(begin, end)]
        first = t.take(pa.array(begin, pa.int64()))
        counts = pa.array([int(j - i) for i, j in zip(begin, end)], pa.int64())
        yield pa.RecordBatch.from_arrays([first["batch"], first["ord"], first["signature"], pa.array(texts, pa.string()), counts], ["batch", "ord", "first", "text", "n"])


def _digests(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row without a text, how many signatures came before it, and their digest."""
    digest, n = hashlib.md5(), 0
    for t in tables:
        out: list[tuple] = []
        for batch, text, more in zip(t["batch"].to_pylist(), t["text"], t["n"].to_pylist()):
            if not text.is_valid:
                out.append((batch, n, digest.hexdigest()))
                continue
            if n:
                digest.update(SEPARATOR.encode())
            digest.update(memoryview(text.as_buffer()))
            n += more
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["batch", "n", "digest"])


def told_digests(accepted: DataFrame, batches: DataFrame) -> DataFrame:
    """batch, n, digest: how many signatures forbidden_signatures tells a batch, and the MD5 of them joined by SEPARATOR.

    The lists of all batches are as long as the product of batches and artifacts, so none is made: texts are joined in pieces by tasks of ordered
    ranges, and the digest, which can only be made in order, goes over these pieces once, a few at a time, and is read before each batch."""
    ordered = accepted.where("signature != '' AND batch IS NOT NULL").select(F.col("batch").cast("long"), "ord", "signature").repartitionByRange("batch", "ord", "signature").sortWithinPartitions("batch", "ord", "signature")
    order = ordered.schema["ord"].dataType.simpleString()
    pieces = ordered.mapInArrow(_pieces, f"batch long, ord {order}, first string, text string, n long")
    asked = batches.select(F.col("batch").cast("long").alias("batch")).distinct()
    marks = asked.select("batch", F.lit(None).cast(order).alias("ord"), F.lit("").alias("first"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    one = pieces.unionByName(marks).withColumn("piece", F.col("text").isNotNull()).repartition(1).sortWithinPartitions("batch", "piece", "ord", "first")
    return one.select("batch", "text", "n").mapInArrow(_digests, "batch long, n long, digest string")


def usable_review(v: Column, criteria: tuple[str, ...]) -> Column:
    """Whether a parsed review has an object of scores with a number for each criterion, and a list of issues."""
    number = lambda k: F.coalesce(kind(F.try_variant_get(v, f"$.semantic_scores.{k}", "variant")).isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL"), F.lit(False))
    shape = F.coalesce((kind(F.try_variant_get(v, "$.semantic_scores", "variant")) == "OBJECT") & (kind(F.try_variant_get(v, "$.issues", "variant")) == "ARRAY"), F.lit(False))
    for c in criteria:
        shape = shape & number(c)
    return shape


def reviews(artifacts: DataFrame, answers: DataFrame, criteria: tuple[str, ...], attempts: int = 3) -> DataFrame:
    """quest_id, review, attempt, available: the first usable answer (quest_id, attempt, v) of each artifact, of several of one attempt
    the first as JSON; where there is none, the review is null, and the gate only warns (see unavailable)."""
    good = answers.where((F.col("attempt") <= attempts) & usable_review(F.col("v"), criteria))
    first = good.groupBy("quest_id").agg(F.min(F.struct("attempt", F.to_json("v").alias("json"))).alias("s")).select("quest_id", "s.attempt", F.parse_json("s.json").alias("v"))
    return artifacts.select("quest_id").join(first, "quest_id", "left").select("quest_id", F.col("v").alias("review"), "attempt", F.col("attempt").isNotNull().alias("available"))


def unavailable(reviewed: DataFrame) -> DataFrame:
    """Issue rows of artifacts without a usable review: a warning each, so they pass."""
    rows = reviewed.where("not available")
    return rows.select("quest_id", F.lit("semantic").alias("validator"), F.lit("SEMANTIC_VALIDATION_UNAVAILABLE").alias("code"), F.lit("warning").alias("severity"), F.lit("").alias("path"), F.lit("").alias("detail"))


def world_facts(entity: DataFrame) -> DataFrame:
    """fact: each entity as JSON, by id, without fields that it has not."""
    return entity.orderBy("entity_id").select(F.to_json(F.struct(F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), *[c for c in ("name", "role", "location_id") if c in entity.columns])).alias("fact"))


def compact_catalog(entity: DataFrame) -> DataFrame:
    """entity_type, ids: sorted; types that occur."""
    return entity.groupBy("entity_type").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))


def set_review_rows(artifacts: DataFrame) -> DataFrame:
    """What a review of the whole set reads of each artifact."""
    v = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    return artifacts.select(*[v(k).alias(k) for k in ("quest_id", "title", "summary", "quest_type", "objectives")], v("reusable_tags").alias("tags"))


def mean_score(scores: DataFrame) -> DataFrame:
    """One row: the mean of what is a number (true counts 1) in scores (v); 0 if nothing is."""
    number = F.when(kind(F.col("v")) == "BOOLEAN", F.col("v").cast("boolean").cast("int").cast("double")).when(kind(F.col("v")).isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL"), F.try_variant_get("v", "$", "double"))
    return scores.agg(F.coalesce(F.avg(number), F.lit(0.0)).alias("score"))
