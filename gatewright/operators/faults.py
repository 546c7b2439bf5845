"""Fault injection over artifact views, and scores of what the gates detect.

Each mutant is an artifact under a new id; a mutation is one conditional expression for each column that it touches.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import Views
from . import array_graphs, gates

#: Fault types and the code that each must raise.
FAULTS = {"unknown_target": "INVALID_OR_IMPLICIT_TARGET", "wrong_giver_type": "INVALID_QUEST_GIVER_TYPE", "duplicate_step_id": "DUPLICATE_STEP_ID", "missing_dependency": "MISSING_STEP_DEPENDENCY", "cyclic_dependency": "CYCLIC_OBJECTIVE_DEPENDENCY"}
#: The gate that raises each fault's code; what mutations write.
GATE = {"unknown_target": "referential", "wrong_giver_type": "referential", "duplicate_step_id": "referential", "missing_dependency": "graph", "cyclic_dependency": "graph"}
NO_ENTITY, NO_STEP = "entity_not_in_world", 999


def mutants(v: Views, wrong_giver: Column, faults: tuple[str, ...] = tuple(FAULTS)) -> tuple[Views, DataFrame]:
    """Views of all mutants (quest_id is '<id>::<fault>'), and mutant_id, quest_id, fault_type, expected_code."""
    fault = F.explode(F.array(*map(F.lit, faults))).alias("fault")
    named = lambda df: df.select("*", fault).withColumn("quest_id", F.concat_ws("::", F.col("quest_id").cast("string"), "fault"))
    is_ = lambda f: F.col("fault") == f
    artifact = named(v.artifact).withColumn("giver", F.when(is_("wrong_giver_type"), wrong_giver).otherwise(F.col("giver")))
    first, second = F.col("pos") == 0, F.col("pos") == 1
    o = named(v.objective.join(v.objective.where("pos = 0").select("quest_id", F.col("step_no").alias("_s0")), "quest_id").join(v.objective.where("pos = 1").select("quest_id", F.col("step_no").alias("_s1")), "quest_id", "left"))
    o = o.withColumn("target", F.when(is_("unknown_target") & first, NO_ENTITY).otherwise(F.col("target")))
    o = o.withColumn("dep_no", F.when(is_("missing_dependency") & first, NO_STEP).when(is_("cyclic_dependency") & first & F.col("_s1").isNotNull(), F.col("_s1")).when(is_("cyclic_dependency") & second, F.col("_s0")).otherwise(F.col("dep_no")))
    o = o.withColumn("step_no", F.when(is_("duplicate_step_id") & second, F.col("_s0")).otherwise(F.col("step_no")))
    expected = F.create_map(*[F.lit(x) for f, c in FAULTS.items() for x in (f, c)])
    ids = v.artifact.select("quest_id", F.explode(F.array(*map(F.lit, faults))).alias("fault_type")).select(F.concat_ws("::", F.col("quest_id").cast("string"), "fault_type").alias("mutant_id"), "quest_id", "fault_type", expected[F.col("fault_type")].alias("expected_code"))
    return replace(v, artifact=artifact.drop("fault"), objective=o.drop("fault", "_s0", "_s1"), reward=named(v.reward).drop("fault")), ids


def _reported(v: Views, wrong_giver: Column) -> bool:
    """Whether the referential gate reports the giver that mutants get. All mutants have the same one, so one artifact is judged."""
    giver = v.artifact.limit(1).select(F.lit(0).alias("quest_id"), wrong_giver.alias("giver"), F.lit("").alias("start"))
    issues = gates.reference_issues(replace(v, artifact=giver, reward=v.reward.limit(0)))
    return not issues.where(F.col("code") == FAULTS["wrong_giver_type"]).isEmpty()


def caught(v: Views, wrong_giver: Column, faults: tuple[str, ...] = tuple(FAULTS)) -> DataFrame:
    """fault_type, validator, total (mutants) and detected (mutants whose expected code is reported); wrong_giver: a literal.

    As detection of the mutants' issues, but a mutant is judged for its expected code only: issues of other codes never count. The mutants of an
    artifact are made of the array of its steps, which is gathered once, and are judged in its row; values that all mutants share are looked up once."""
    steps = v.objective.where("quest_id is not null").groupBy("quest_id").agg(F.sort_array(F.collect_list(F.struct("pos", "step_no", "dep_no"))).alias("steps"))
    g = steps.withColumns({"numbers": F.transform("steps", lambda s: s["step_no"]), "needs": F.transform("steps", lambda s: s["dep_no"])})
    n = {f: F.lit(False) for f in faults}
    two, own = F.size("steps") > 1, lambda xs, k: F.try_element_at(xs, F.lit(k))
    beyond = lambda xs, k: F.slice(xs, k + 1, F.greatest(F.size(xs) - k, F.lit(0)))
    if "unknown_target" in n:
        unknown = v.entity.where(F.col("entity_id") == NO_ENTITY).isEmpty()
        if unknown:
            n["unknown_target"] = F.size("steps") > 0
        else:  # the mutated step is no longer a fault: another one may be
            target = F.when(F.col("pos") == 0, NO_ENTITY).otherwise(F.col("target"))
            found = gates.judged_targets(replace(v, objective=v.objective.withColumn("target", target))).where(F.col("found") == FAULTS["unknown_target"])
            g = g.join(found.select("quest_id", F.lit(True).alias("unknown")).distinct(), "quest_id", "left")
            n["unknown_target"] = F.coalesce("unknown", F.lit(False))
    if "duplicate_step_id" in n:
        made = F.when(two, F.concat(F.array(own("numbers", 1), own("numbers", 1)), beyond("numbers", 2))).otherwise(F.col("numbers"))
        g = g.withColumn("repeated", made)
        n["duplicate_step_id"] = F.size(F.array_distinct("repeated")) < F.size("repeated")
    if "missing_dependency" in n:
        made = F.concat(F.array(F.lit(NO_STEP).cast("long")), beyond("needs", 1).cast("array<long>"))
        n["missing_dependency"] = F.size(F.array_except(F.array_compact(made), F.concat("numbers", F.array(F.lit(0).cast("long"))))) > 0
    if "cyclic_dependency" in n:
        made = F.when(two, F.concat(F.array(own("numbers", 2), own("numbers", 1)), beyond("needs", 2).cast("array<long>"))).otherwise(F.col("needs").cast("array<long>"))
        edges = F.filter(F.arrays_zip(made.alias("src"), F.col("numbers").alias("dst")), lambda e: e["src"] != 0)
        g = g.withColumn("ring", array_graphs.cyclic(edges))
        n["cyclic_dependency"] = F.col("ring")
    each = [f for f in faults if f != "wrong_giver_type"]
    sums = g.agg(*[F.count_if(n[f]).alias(f) for f in each]).crossJoin(v.artifact.agg(F.count("*").alias("total")))
    giver = F.col("total") if "wrong_giver_type" in n and _reported(v, wrong_giver) else F.lit(0).cast("long")
    row = lambda f: F.struct(F.lit(f).alias("fault_type"), F.lit(GATE[f]).alias("validator"), F.col("total").alias("total"), (giver if f == "wrong_giver_type" else F.col(f)).alias("detected"))
    return sums.select(F.inline(F.array(*map(row, faults))))


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy")]


def detection(ids: DataFrame, issues: DataFrame, by: str) -> DataFrame:
    """For each value of by (fault_type or validator): mutants, and those whose expected code was reported."""
    hit = issues.select(F.col("quest_id").alias("mutant_id"), F.col("code").alias("expected_code"), "validator").distinct()
    if by == "fault_type":
        found = ids.join(hit, ["mutant_id", "expected_code"], "left_semi").groupBy("fault_type").agg(F.count("*").alias("detected"))
        return ids.groupBy("fault_type").agg(F.count("*").alias("total")).join(found, "fault_type", "left").select("fault_type", "total", F.coalesce("detected", F.lit(0)).cast("long").alias("detected"))
    return ids.join(hit, ["mutant_id", "expected_code"]).groupBy("validator").agg(F.count_distinct("mutant_id").alias("tp"))
