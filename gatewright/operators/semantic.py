"""The semantic gate's deterministic side: proposals of issues are held against the artifact's own fields.

A model proposes; these columns decide. A proposal is accepted only where its stated evidence holds, kept as advice where
it is a matter of taste, and discarded otherwise. The severity comes from the policy, never from the proposal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, squeeze
from ..sources.artifacts import at, elements, is_object, kind, numbered, text

#: Severities of codes that can be accepted, codes that are advice only, criteria with the codes that
#: support a low score, the least score, combat actions, stems of absence, conditions that say nothing.
SEVERITY = {"IMPLICIT_ENTITY": "error", "UNTRACKED_NARRATIVE_ENTITY": "error", "NARRATIVE_CONTRADICTION": "error", "QUEST_GIVER_STATE_CONTRADICTION": "error", "UNCLEAR_OBJECTIVE": "warning", "UNCLEAR_ITEM_ACQUISITION": "warning", "UNMODELLED_COMBAT_DEPENDENCY": "error"}
ADVISORY = ("SUMMARY_OBJECTIVE_MISMATCH", "LOW_REUSABILITY", "LOW_MAINTAINABILITY", "LOW_GAME_DESIGN_QUALITY")
CRITERIA = ("narrative_consistency", "gameplay_clarity", "integration_readiness", "reusability", "maintainability", "game_design_quality")
SUPPORT = {"narrative_consistency": ("NARRATIVE_CONTRADICTION", "QUEST_GIVER_STATE_CONTRADICTION"), "gameplay_clarity": ("UNCLEAR_OBJECTIVE", "UNCLEAR_ITEM_ACQUISITION"), "integration_readiness": ("IMPLICIT_ENTITY", "UNTRACKED_NARRATIVE_ENTITY", "UNMODELLED_COMBAT_DEPENDENCY")}
LEAST_SCORE = 3
#: Fixed value: the message of a proposal without an explanation.
NO_MESSAGE = "Problema semântico."
COMBAT = ("defeat", "combat", "fight")
ABSENT = ("sequestrad", "desaparecid", "aprisionad", "capturad", "morto", "morta", "indisponivel", "indisponível")
EMPTY_CONDITIONS = ("completar o objetivo", "concluir o objetivo", "terminar a missao", "terminar a missão", "resolver o problema", "fazer isso")


def _text(v: Column) -> Column:
    """A scalar as stripped text: missing is empty, JSON null is None."""
    return py_strip(F.when(kind(v) == "VOID", "None").otherwise(F.coalesce(v.cast("string"), F.lit(""))))


def _loose(v: Column) -> Column:
    """A value squeezed; null, missing, zero and false are empty."""
    s = squeeze(F.coalesce(F.when(kind(v) != "VOID", v.cast("string")), F.lit("")))
    return F.when((kind(v) == "STRING") | ~s.isin("0", "0.0", "false"), s).otherwise("")


def facts(artifacts: DataFrame) -> DataFrame:
    """What adjudication reads of each artifact (quest_id, v): giver, narrative, steps (action, target, condition)."""
    v = F.col("v")
    steps = F.transform(numbered(at(v, "objectives")), lambda s: F.struct(text(at(s["v"], "action")).alias("action"), _text(at(s["v"], "target")).alias("target"), _loose(at(s["v"], "success_condition")).alias("condition")))
    before = F.transform(F.filter(elements(at(v, "preconditions")), lambda x: kind(x) == "STRING"), lambda x: squeeze(text(x)))
    narrative = F.array_join(F.concat(F.array(_loose(at(v, "title")), _loose(at(v, "summary"))), before), " ")
    return artifacts.select("quest_id", _text(at(v, "giver_npc")).alias("giver"), narrative.alias("narrative"), steps.alias("steps"))


def proposals(raw: DataFrame) -> DataFrame:
    """Typed proposals from raw ones (quest_id, n, raw: VARIANT): object, code, rule, entity_id, at (a place, or null)."""
    r = F.col("raw")
    evidence = F.when(is_object(at(r, "evidence")), at(r, "evidence"))
    place = at(evidence, "objective_index")
    whole = kind(place).isin("TINYINT", "SMALLINT", "INT", "BIGINT")
    told = F.coalesce(F.when(kind(at(r, "explanation")) == "VOID", "None").otherwise(at(r, "explanation").cast("string")), F.lit(NO_MESSAGE))
    return raw.select(
        "quest_id", "n", is_object(r).alias("object"), F.upper(_text(at(r, "code"))).alias("code"), _text(at(evidence, "rule")).alias("rule"), _text(at(evidence, "entity_id")).alias("entity_id"),
        F.when(whole, place.cast("long")).alias("at"), told.alias("message"), *[_text(at(r, k)).alias(k) for k in ("path", "suggestion")],
    )


def _chain(tests: list[tuple[Column, str, str]]) -> Column:
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return reduce(lambda c, t: c.when(t[0], made(t[1], t[2])), tests, F.when(F.lit(False), made("", "")))


def adjudicate(typed: DataFrame, of: DataFrame, entity: DataFrame) -> DataFrame:
    """typed with decision and reason; of is facts() of the artifacts, entity the catalog (entity_id, entity_type)."""
    p = typed.join(of, "quest_id", "left")
    step = F.when((F.col("at") >= 0) & (F.col("at") < F.size("steps")), F.get("steps", F.col("at").cast("int")))
    p = p.withColumn("step", step)
    named = entity.select(F.col("entity_id").alias("_named"), F.lit(True).alias("_known"))
    target = entity.select(F.col("entity_id").alias("_target"), F.col("entity_type").alias("_type"))
    p = p.join(named, F.col("entity_id") == F.col("_named"), "left").join(target, F.col("step.target") == F.col("_target"), "left")

    code, rule, giver = F.col("code"), F.col("rule"), F.col("giver")
    no_step, condition = F.col("step").isNull(), F.col("step.condition")
    says_nothing = (condition == "") | condition.isin(*EMPTY_CONDITIONS)
    aims = lambda actions: F.exists("steps", lambda s: s["action"].isin(*actions) & (s["target"] == giver))
    absent = reduce(Column.__or__, [F.col("narrative").contains(x) for x in ABSENT])
    holds = F.when(giver == "", False).when(rule == "giver_is_rescue_target", aims(["rescue"])).when(rule == "giver_is_defeat_target", aims(COMBAT)).when(rule == "giver_unavailable_but_required", (F.col("entity_id") == giver) & absent & aims(["talk", "deliver", "return"])).otherwise(False)
    holds = F.coalesce(holds, F.lit(False))
    blank = (F.coalesce(py_strip(F.col("step.action")), F.lit("")) == "") | (F.col("step.target") == "") | says_nothing
    is_ = lambda *codes: code.isin(*codes)
    entities, combat, unclear, item = is_("IMPLICIT_ENTITY", "UNTRACKED_NARRATIVE_ENTITY"), is_("UNMODELLED_COMBAT_DEPENDENCY"), is_("UNCLEAR_OBJECTIVE"), is_("UNCLEAR_ITEM_ACQUISITION")
    stated = [(entities, "untracked_entity_id"), (combat, "combat_target_not_modelled"), (unclear, "unclear_objective_at_index"), (item, "unclear_item_acquisition_at_index")]
    not_action = lambda actions: ~F.coalesce(F.col("step.action").isin(*actions), F.lit(False))
    of_type = lambda t: F.coalesce(F.col("_type") == t, F.lit(False))
    found = _chain([
        (~F.col("object"), "discarded", "issue_not_an_object"),
        (~is_(*SEVERITY, *ADVISORY), "discarded", "unsupported_issue_code"),
        (rule == "", "discarded", "missing_structured_evidence"),
        (is_(*ADVISORY), "advisory", "subjective_human_review"),
        (is_(*SUPPORT["narrative_consistency"]) & holds, "accepted", "verified_against_quest_fields"),
        (is_(*SUPPORT["narrative_consistency"]), "discarded", "contradicted_by_quest_fields"),
        (reduce(Column.__or__, [c & (rule != r) for c, r in stated]), "discarded", "unsupported_evidence_rule"),
        (entities & (F.col("entity_id") == ""), "discarded", "missing_entity_id_evidence"),
        (entities & F.col("_known").isNotNull(), "discarded", "entity_exists_in_world"),
        (entities, "accepted", "entity_absent_from_world"),
        (no_step, "discarded", "invalid_objective_index"),
        (combat & not_action(COMBAT), "discarded", "objective_is_not_combat"),
        (combat & of_type("enemy"), "discarded", "combat_target_is_modelled_enemy"),
        (combat, "accepted", "combat_target_not_modelled"),
        (unclear & blank, "accepted", "objective_has_unverifiable_fields"),
        (unclear, "discarded", "objective_is_concrete"),
        (item & not_action(["collect"]), "discarded", "objective_is_not_collection"),
        (item & ~of_type("item"), "accepted", "collection_target_is_not_item"),
        (item & says_nothing, "accepted", "collection_condition_is_not_verifiable"),
        (item, "discarded", "item_acquisition_is_concrete"),
    ])
    other = F.struct(F.lit("discarded").alias("decision"), F.lit("no_deterministic_adjudication_rule").alias("reason"))
    return p.select(*typed.columns, F.coalesce(found, other).alias("j")).select(*typed.columns, "j.decision", "j.reason")


def accepted_issues(judged: DataFrame) -> DataFrame:
    """Issue rows of the accepted proposals."""
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return judged.where("decision = 'accepted'").select("quest_id", F.lit("semantic").alias("validator"), "code", severity[F.col("code")].alias("severity"), "path", F.col("message").alias("detail"))


def low_scores(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """LOW_<CRITERION> errors for scores (quest_id, criterion, score) below the least that an accepted code supports."""
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(k).alias("code")) for c, ks in SUPPORT.items() for k in ks])
    support = judged.where("decision = 'accepted'").select("quest_id", F.col("code").alias("_code"), F.explode(pairs).alias("s")).where("s.code = _code").select("quest_id", "s.criterion")
    low = scores.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("score").cast("double")))).where(F.col("score") < LEAST_SCORE)
    rows = low.join(support, ["quest_id", "criterion"], "left_semi")
    return rows.select("quest_id", F.lit("semantic").alias("validator"), F.concat(F.lit("LOW_"), F.upper("criterion")).alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("semantic_scores."), "criterion").alias("path"), F.col("score").cast("string").alias("detail"))


def rollup(judged: DataFrame) -> DataFrame:
    """Counts of each artifact's proposals by decision, and the share that was discarded."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return judged.groupBy("quest_id").agg(F.count("*").alias("raw"), n("accepted").alias("accepted"), n("advisory").alias("advisory"), n("discarded").alias("discarded")).withColumn("discarded_rate", F.col("discarded") / F.col("raw"))
