"""The semantic gate as a whole: recorded reviews in, issue rows and a record for each artifact out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import at, elements, kind
from . import generation, semantic
from .gates import union

NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")


def clipped(v: Column) -> Column:
    """A score between 0 and 5; what is no number counts 0."""
    number = F.when(kind(v).isin(*NUMBERS), F.try_variant_get(v, "$", "double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(number, F.lit(0.0))))


def semantic_gate(artifacts: DataFrame, answers: DataFrame, entity: DataFrame, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Issue rows, and a record for each artifact (quest_id, v).

    answers: quest_id, attempt, v, a recorded review each. The first that is usable counts; an artifact without one gets a warning only, and a
    record of zeros. Records: quest_id, status, attempts, scores, overall_score (the mean of all criteria), short_review,
    raw, accepted, advisory, discarded, discarded_rate."""
    reviewed = generation.reviews(artifacts, answers, semantic.CRITERIA, attempts)
    there = reviewed.where("available")
    raw = there.select("quest_id", F.posexplode(elements(at(F.col("review"), "issues"))).alias("n", "raw"))
    judged = semantic.adjudicate(semantic.proposals(raw), semantic.facts(artifacts), entity)
    each = F.array(*[F.struct(F.lit(c).alias("criterion"), clipped(at(F.col("review"), f"semantic_scores.{c}")).alias("score")) for c in semantic.CRITERIA])
    scores = there.select("quest_id", F.inline(each))
    issues = union([x.select("quest_id", "validator", "code", "severity", "path", "detail") for x in (semantic.accepted_issues(judged), semantic.low_scores(scores, judged), generation.unavailable(reviewed))])
    total = F.aggregate(each, F.lit(0.0), lambda a, s: a + s["score"]) / len(semantic.CRITERIA)
    zero = F.lit(0).cast("long")
    said = F.when(F.col("available"), F.coalesce(at(F.col("review"), "short_review").cast("string"), F.lit(""))).otherwise("")
    records = reviewed.join(semantic.rollup(judged), "quest_id", "left").select(
        "quest_id", F.when(F.col("available"), "completed").otherwise("unavailable").alias("status"), F.coalesce("attempt", F.lit(attempts)).cast("int").alias("attempts"),
        F.when(F.col("available"), F.map_from_entries(each)).alias("scores"), F.when(F.col("available"), total).alias("overall_score"), said.alias("short_review"),
        *[F.coalesce(c, zero).alias(c) for c in ("raw", "accepted", "advisory", "discarded")], F.coalesce("discarded_rate", F.lit(0.0)).alias("discarded_rate"),
    )
    return issues, records
