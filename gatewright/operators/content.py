"""The content gate over JSON artifacts: completion conditions, preconditions and success conditions that say too little."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..sources.artifacts import at, elements, kind, numbered

#: Texts that make a condition generic, or a precondition weak, and the shortest clear success condition.
GENERIC = (r"complet\w*.*(todos|os).*(objetivos|passos)", r"finaliz(ar|e|ou).*(a|esta).*(quest|miss[aã]o)")
WEAK = (r"est[aá] dispon[ií]vel", r"est[aá] acess[ií]vel", r"pode iniciar")
CLEAR_LENGTH = 12


def _shown(v: Column) -> Column:
    """A value as text: JSON null is None, a missing one is empty."""
    return F.when(kind(v) == "VOID", "None").otherwise(F.coalesce(v.cast("string"), F.lit("")))


def says(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a condition's text matches one of the patterns."""
    return F.lower(py_strip(text)).rlike("|".join(f"(?Ud:{p})" for p in patterns))


def _matching(artifacts: DataFrame, key: str, patterns: tuple[str, ...], code: str, severity: str) -> DataFrame:
    rows = artifacts.select("quest_id", F.posexplode(F.transform(elements(at(F.col("v"), key)), _shown)).alias("pos", "detail"))
    return rows.where(says(F.col("detail"), patterns)).select("quest_id", F.lit("content").alias("validator"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.format_string(f"{key}[%d]", "pos").alias("path"), "detail")


def content_gate(artifacts: DataFrame) -> DataFrame:
    """Issue rows for artifacts (quest_id, v)."""
    generic = _matching(artifacts, "completion_conditions", GENERIC, "GENERIC_COMPLETION_CONDITION", "error")
    weak = _matching(artifacts, "preconditions", WEAK, "WEAK_PRECONDITION", "warning")
    said = F.transform(numbered(at(F.col("v"), "objectives")), lambda s: F.struct(s["pos"].alias("pos"), _shown(at(s["v"], "success_condition")).alias("detail")))
    steps = artifacts.select("quest_id", F.inline(said)).where(F.length(py_strip(F.col("detail"))) < CLEAR_LENGTH)
    unclear = steps.select("quest_id", F.lit("content").alias("validator"), F.lit("UNCLEAR_SUCCESS_CONDITION").alias("code"), F.lit("warning").alias("severity"), F.format_string("objectives[%d].success_condition", "pos").alias("path"), "detail")
    return generic.unionByName(weak).unionByName(unclear)
