"""Prompts as columns: what a generator, a reviewer and a repairer are told, with the catalog, the schema and the artifact as JSON.

A prompt has its rules first and its data behind headings, so a recorded response can be traced to what was asked. The catalog and the schema
are literals of the plan: a catalog of many thousand entities is told by its types (compact), not in full.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import semantic

#: Names of the evidence that a review may state.
EVIDENCE = ("giver_is_rescue_target", "giver_is_defeat_target", "giver_unavailable_but_required", "untracked_entity_id", "combat_target_not_modelled", "unclear_objective_at_index", "unclear_item_acquisition_at_index")
SET_CRITERIA = ("diversity", "entity_coverage", "design_balance", "maintainability", "scalability")
RULES = (
    "giver_npc names an npc, start_location a location, item rewards name items; targets exist in the catalog and suit their action.",
    "There are 2 to 4 objectives, numbered step_001, step_002 and so on; each depends on earlier steps only, the first on none.",
    "Success and completion conditions are concrete texts; no text is empty; reusable_tags are at least two distinct snake_case texts.",
    "An npc that is rescued does not give the quest; nobody and nothing is named that the catalog does not have.",
    "The result complies with the JSON schema.",
)
RETRY = ("", "\n\nRETRY: one JSON object only, no list, no wrapper, no other text; issues is a list, empty if nothing blocks.", "\n\nLAST RETRY: exactly this shape: ")


def _json(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, indent=2)


def _parts(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def rules_text(first: str, extra: tuple[str, ...] = ()) -> str:
    return first + "\n\nRULES:\n" + "\n".join(f"{n}. {r}" for n, r in enumerate((*extra, *RULES), 1)) + "\n"


def generation_prompt(requests: DataFrame, catalog: dict[str, list[str]], schema: dict[str, Any], told: DataFrame | None = None) -> DataFrame:
    """batch, prompt for requests (batch, n); told: batch, signatures that are not to be repeated."""
    rows = requests.join(told, "batch", "left") if told is not None else requests.withColumn("signatures", F.lit(None).cast("array<string>"))
    avoid = F.to_json(F.coalesce("signatures", F.expr("cast(array() as array<string>)")))
    name = F.format_string("batch_%02d_quest_NNN", F.col("batch").cast("int"))
    head = _parts('Return JSON with the one key quests: a list of ', F.col("n").cast("string"), " quests, with ids ", name, ", texts in Portuguese.\n")
    return rows.select("batch", _parts(head, rules_text(""), "\nCATALOG:\n" + _json(catalog) + "\n\nSCHEMA:\n" + _json(schema) + "\n\nFORBIDDEN SIGNATURES:\n", avoid).alias("prompt"))


def baseline_prompt(requests: DataFrame, catalog: dict[str, list[str]]) -> DataFrame:
    """batch, prompt for requests (batch, n), without rules or schema."""
    name = F.format_string("batch_%02d_quest_", F.col("batch").cast("int"))
    text = _parts("Return JSON with the one key quests: a list of ", F.col("n").cast("string"), " quests, with ids that begin with ", name, ", inspired by this world:\n" + _json(catalog))
    return requests.select("batch", text.alias("prompt"))


def review_prompt(artifacts: DataFrame, facts: list[str], attempt: int = 1) -> DataFrame:
    """quest_id, prompt: what a reviewer is asked about each artifact at its first, second or third attempt; facts: JSON of the world's entities."""
    shape = {"semantic_scores": dict.fromkeys(semantic.CRITERIA, 0), "issues": [{"code": "", "explanation": "", "suggestion": "", "path": "", "evidence": {"rule": "", "entity_id": "", "objective_index": 0}}], "short_review": ""}
    least = {"semantic_scores": dict.fromkeys(semantic.CRITERIA, 5), "issues": [], "short_review": ""}
    ask = "Review one quest. Report at most two issues, each with evidence from its own fields; schema, ids, types and dependencies have been checked.\n"
    codes = "ISSUE CODES: " + ", ".join(semantic.SEVERITY) + "\nEVIDENCE RULES: " + ", ".join(EVIDENCE) + "\nSHAPE:\n" + json.dumps(shape) + "\n\nWORLD:\n[" + ", ".join(facts) + "]\n\nQUEST:\n"
    again = RETRY[attempt - 1] + (json.dumps(least) if attempt == len(RETRY) else "")
    return artifacts.select("quest_id", _parts(ask + codes, F.to_json("v"), again).alias("prompt"))


def repair_prompt(artifacts: DataFrame, issues: DataFrame, catalog: dict[str, list[str]], schema: dict[str, Any], attempt: int) -> DataFrame:
    """quest_id, prompt: an artifact with its errors and warnings, and what its repair must keep to."""
    told = issues.where(F.col("severity").isin("warning", "error")).groupBy("quest_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("validator", "code", "severity", "path", "detail")))).alias("told"))
    head = rules_text(f"Repair one quest and return it as one JSON object. This is attempt {attempt}.", ("The quest's id and generation fields stay, and so does all that is valid.", "Each of the issues is mended."))
    text = _parts(head + "\nCATALOG:\n" + _json(catalog) + "\n\nSCHEMA:\n" + _json(schema) + "\n\nISSUES:\n", F.coalesce("told", F.lit("[]")), "\n\nQUEST:\n", F.to_json("v"))
    return artifacts.join(told, "quest_id", "left").select("quest_id", text.alias("prompt"))


def set_review_prompt(rows: DataFrame, metrics: dict[str, Any]) -> DataFrame:
    """One row, prompt: what a review of a whole set is asked (rows as generation.set_review_rows has them).

    A reviewer reads a set in one prompt, so this is for sets of a prompt's size; metrics stand for larger ones."""
    shape = {"set_scores": dict.fromkeys(SET_CRITERIA, 0), "duplicated_or_similar_quests": [], "overused_entities": [], "overused_patterns": [], "strengths": [], "weaknesses": [], "recommendations": [], "short_review": ""}
    quests = F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns)))), ",\n")
    return rows.agg(_parts("Review this set of quests; the metrics are evidence. Scores are 0 to 5.\nSHAPE:\n" + json.dumps(shape) + "\n\nMETRICS:\n" + _json(metrics) + "\n\nSET:\n[", quests, "]").alias("prompt"))
