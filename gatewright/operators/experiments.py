"""The gates composed, and the five configurations of an experiment over generated artifacts.

C1: prompt only; C2: guided by the schema; C3: C2 behind the gate; C4: C2's valid artifacts and its repaired ones; C5: the same with
diversity-aware repair, whose state starts from C2's valid artifacts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.artifacts import from_json
from ..sources.views import Views
from . import diversity, gates, json_gates, repair
from .content import content_gate
from .diversity_repair import folded
from .schema_gate import schema_gate

Gate = Callable[[DataFrame], DataFrame]
#: What each of the four gates may raise.
CODES = {
    "schema": ("SCHEMA_VIOLATION",),
    "referential": ("UNKNOWN_ENTITY", "INVALID_QUEST_GIVER_TYPE", "INVALID_START_LOCATION_TYPE", "INVALID_REWARD_ITEM_TYPE", "DUPLICATE_STEP_ID", "INVALID_OR_IMPLICIT_TARGET", "INCOMPATIBLE_ACTION_TARGET"),
    "graph": ("MISSING_STEP_DEPENDENCY", "CYCLIC_OBJECTIVE_DEPENDENCY", "MULTIPLE_OBJECTIVE_ROOTS", "UNREACHABLE_OBJECTIVE", "INVALID_DEPENDENCY_LIST"),
    "content": ("UNCLEAR_SUCCESS_CONDITION", "GENERIC_COMPLETION_CONDITION", "WEAK_PRECONDITION"),
}
ISSUE = ("quest_id", "validator", "code", "severity", "path", "detail")


@dataclass(frozen=True)
class Application:
    """A catalog, a schema, and the gates by name in their order. A gate is a function from artifacts (quest_id, v) to issue rows."""

    entity: DataFrame
    schema: dict[str, Any]
    gates: dict[str, Gate]
    #: Fitting types by action, where the four gates are this module's own.
    compat: dict[str, tuple[str, ...]] | None = None

    def validate(self, artifacts: DataFrame) -> DataFrame:
        """Issue rows of all gates."""
        return gates.union([g(artifacts).select(*ISSUE) for g in self.gates.values()])

    def expected(self, made: DataFrame) -> DataFrame:
        """Issue rows of mutants (quest_id, v, expected_code) that can count: each gate judges those whose expected code it may raise; a gate
        whose codes are not known judges all."""
        def judged(name: str) -> DataFrame:
            return made.where(F.col("expected_code").isin(list(CODES[name]))) if name in CODES else made

        return gates.union([g(judged(name).select("quest_id", "v")).select(*ISSUE) for name, g in self.gates.items()])

    def report(self, artifacts: DataFrame) -> DataFrame:
        """A row for each artifact and gate, clean ones included."""
        counted: list[DataFrame] = []
        others = self.gates
        if self.compat is not None:
            counted.append(json_gates.report(artifacts, self.entity, self.schema, self.compat))
            others = {name: g for name, g in self.gates.items() if name not in CODES}
        if others:
            issues = gates.union([g(artifacts).select(*ISSUE) for g in others.values()])
            counts = issues.groupBy("quest_id", "validator").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
            grid = artifacts.select("quest_id", F.explode(F.array(*map(F.lit, others))).alias("validator"))
            counted.append(grid.join(counts, ["quest_id", "validator"], "left"))
        zero = F.lit(0).cast("long")
        return gates.union(counted).select("quest_id", "validator", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (F.coalesce("errors", zero) == 0).alias("passed"))


def views(artifacts: DataFrame, entity: DataFrame, compat: dict[str, tuple[str, ...]] = repair.ACTION_TYPES) -> Views:
    return from_json(artifacts if "ord" in artifacts.columns else artifacts.withColumn("ord", F.lit(0).cast("long")), entity, compat)


def build_application(entity: DataFrame, schema: dict[str, Any], compat: dict[str, tuple[str, ...]] = repair.ACTION_TYPES, more: dict[str, Gate] | None = None) -> Application:
    """The four gates in their order (schema, referential, graph, content), and any more."""
    own: dict[str, Gate] = {
        "schema": lambda a: schema_gate(a, schema),
        "referential": lambda a: gates.referential(views(a, entity, compat)),
        "graph": lambda a: gates.graph(views(a, entity, compat)),
        "content": content_gate,
    }
    more = more or {}
    return Application(entity, schema, own | more, None if set(own) & set(more) else compat)


def summary(app: Application, artifacts: DataFrame, passes: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, validity_rate, mean errors and warnings, and set metrics of all artifacts and of the valid ones.

    passes: quest_id, passed, errors, warnings."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}")
    counts = passes.agg(F.count("*").alias("total"), F.count_if("passed").alias("valid"), mean("errors"), mean("warnings"))
    rate = F.coalesce(F.try_divide(F.col("valid").cast("double"), "total"), F.lit(0.0))
    out = counts.select("*", (F.col("total") - F.col("valid")).alias("invalid"), rate.alias("validity_rate"))
    valid = artifacts.join(passes.where("passed").select("quest_id"), "quest_id", "left_semi")
    for name, some in (("all", artifacts), ("valid", valid)):
        m = diversity.set_metrics(views(some, app.entity))
        out = out.crossJoin(m.select(*[F.col(c).alias(f"{name}_{c}") for c in m.columns]))
    return out


def experiment(app: Application, c1: DataFrame, c2: DataFrame, keep: Callable[[DataFrame, str], DataFrame], responses: DataFrame | None = None, recover: Callable | None = None) -> dict[str, DataFrame]:
    """Summaries of configurations C1 to C5 (one row each, with configuration, published and rejected), and records of C4's and C5's repairs.

    c1, c2: keyed artifacts of the two ways of generation. keep(df, name) writes a table and reads it back."""
    out: dict[str, DataFrame] = {}

    def told(name: str, artifacts: DataFrame, passes: DataFrame, published: DataFrame, total: DataFrame) -> DataFrame:
        n = published.agg(F.count("*").alias("published")).crossJoin(total.agg(F.count("*").alias("generated")))
        return summary(app, artifacts, passes).crossJoin(n).select(F.lit(name).alias("configuration"), "*", (F.col("generated") - F.col("published")).alias("rejected"))

    passes = {name: keep(gates.artifact_passes(app.report(a)), f"passes_{name}") for name, a in (("C1", c1), ("C2", c2))}
    good = passes["C2"].where("passed")
    out["C1"] = told("C1", c1, passes["C1"], c1, c1)
    out["C2"] = told("C2", c2, passes["C2"], c2, c2)
    out["C3"] = told("C3", c2, passes["C2"], good, c2)
    valid, broken = (c2.join(good.select("quest_id"), "quest_id", how) for how in ("left_semi", "left_anti"))
    for name in ("C4", "C5"):
        fold = folded(app.entity, app.schema, views(valid, app.entity)) if name == "C5" else None
        under = lambda df, n, c=name: keep(df, f"{c}_{n}")
        records = keep(repair.orchestrate(broken, app.entity, app.schema, app.validate, under, responses, recover=recover, fold=fold), f"records_{name}")
        final = keep(valid.select("quest_id", "ord", "v").unionByName(repair.routed(records)[0]), f"final_{name}")
        again = keep(gates.artifact_passes(app.report(final)), f"passes_{name}")
        out[name], out[f"records_{name}"] = told(name, final, again, final, c2), records
    return out


def long_metrics(summaries: list[DataFrame], metrics: list[str]) -> DataFrame:
    """configuration, metric, value of summaries."""
    wide = gates.union([s.select("configuration", *[F.col(m).cast("double").alias(m) for m in metrics]) for s in summaries])
    return wide.unpivot("configuration", metrics, "metric", "value")


def numeric_summary(values: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of values (value: double, ord): count, mean, sample deviation (0 of one), least, most, and the values in order.
    Missing values are skipped; groups without any are left out."""
    v = values.where("value IS NOT NULL")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"])
    return v.groupBy(*keys).agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("standard_deviation"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), in_order.alias("values"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, delta of values of two configurations."""
    return a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys).withColumn("delta", F.col("b") - F.col("a"))


def run_table(values: DataFrame, names: list[str]) -> DataFrame:
    """A row for each run and configuration with a column for each metric (null where it has none)."""
    return values.groupBy("run", "configuration").pivot("metric", names).agg(F.first("value"))
