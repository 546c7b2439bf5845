"""Quality gates over artifact views. Each gate returns issue rows: quest_id, validator, code, severity, path, detail.

Catalog joins are plain equi-joins on the entity id; Spark broadcasts the catalog while it is under its size threshold
and sorts and merges beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import py_strip
from ..sources.views import Views
from . import array_graphs, long_graphs
from .long_graphs import LONG

VALIDATORS = ("referential", "graph", "content")
#: How many cycles the issue of a cyclic graph names.
CYCLES = 3
#: Codes of a graph as a whole.
WHOLE = ("CYCLIC_OBJECTIVE_DEPENDENCY", "MULTIPLE_OBJECTIVE_ROOTS", "UNREACHABLE_OBJECTIVE")


def _issue(df: DataFrame, validator: str, code: str, severity: str, path: Column, detail: Column) -> DataFrame:
    return df.select("quest_id", F.lit(validator).alias("validator"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"), detail.cast("string").alias("detail"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def references(v: Views) -> DataFrame:
    """Each reference outside objectives: quest_id, path, ref, and the types expected there."""
    item = F.array(*map(F.lit, v.item_types))
    return union([
        v.artifact.select("quest_id", F.lit("giver_npc").alias("path"), F.col("giver").alias("ref"), F.array(F.lit(v.giver_type)).alias("want")),
        v.artifact.select("quest_id", F.lit("start_location"), F.col("start"), F.array(F.lit(v.start_type))).toDF("quest_id", "path", "ref", "want"),
        v.reward.where("type = 'item'").select("quest_id", F.format_string("rewards[%d].value", "pos"), F.col("value"), item).toDF("quest_id", "path", "ref", "want"),
    ])


def resolve(df: DataFrame, v: Views, ref: str) -> DataFrame:
    """df with the entity_type of its reference (stripped; null if unknown); blank references are left out."""
    e = v.entity.select(F.col("entity_id").alias("_id"), "entity_type")
    return df.where(py_strip(F.col(ref)) != "").join(e, py_strip(F.col(ref)) == F.col("_id"), "left").drop("_id")


def reference_issues(v: Views) -> DataFrame:
    """Issues of references outside objectives."""
    known = resolve(references(v), v, "ref")
    wrong = {"giver_npc": "INVALID_QUEST_GIVER_TYPE", "start_location": "INVALID_START_LOCATION_TYPE"}
    of_path = reduce(lambda c, x: c.when(F.col("path") == x[0], x[1]), wrong.items(), F.when(F.lit(False), "")).otherwise("INVALID_REWARD_ITEM_TYPE")
    code = F.when(F.col("entity_type").isNull(), "UNKNOWN_ENTITY").when(~F.array_contains("want", F.col("entity_type")), of_path)
    return known.select("quest_id", F.lit("referential").alias("validator"), code.alias("code"), F.lit("error").alias("severity"), "path", F.col("ref").alias("detail")).where("code is not null")


def judged_targets(v: Views) -> DataFrame:
    """v.objective with found: the code of what is wrong with an objective's target, or null; blank targets are not judged."""
    e = v.entity.select(F.col("entity_id").alias("_id"), "entity_type")
    actions = v.compat.groupBy(F.lower("action").alias("_action")).agg(F.collect_set("entity_type").alias("allowed"))
    target, action = py_strip(F.col("target")), F.lower(py_strip(F.col("action")))
    rows = v.objective.join(e, target == F.col("_id"), "left").withColumn("_action", action).join(actions, "_action", "left")
    unknown, unfit = F.col("entity_type").isNull(), F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("entity_type"))
    found = F.when(target == "", None).when(unknown, "INVALID_OR_IMPLICIT_TARGET").when(unfit, "INCOMPATIBLE_ACTION_TARGET")
    return rows.withColumn("found", F.when(F.col("target").isNotNull(), found)).drop("_id", "_action", "entity_type", "allowed")


def referential(v: Views) -> DataFrame:
    duplicate = stated_steps(v).groupBy("quest_id", "step_no").count().where("count > 1")
    targets = judged_targets(v).where("found is not null")
    path = F.format_string("objectives[%d].target", "pos")
    told = targets.select("quest_id", F.lit("referential").alias("validator"), F.col("found").alias("code"), F.lit("error").alias("severity"), path.alias("path"), F.col("target").alias("detail"))
    return union([reference_issues(v), _issue(duplicate, "referential", "DUPLICATE_STEP_ID", "error", F.lit("objectives"), F.col("step_no")), told])


def dependencies(v: Views) -> DataFrame:
    """quest_id, pos, step_no, dep_no, explicit."""
    return v.dependency if v.dependency is not None else v.objective.where("dep_no != 0").select("quest_id", "pos", "step_no", "dep_no", F.lit(True).alias("explicit"))


def stated_steps(v: Views) -> DataFrame:
    """Objectives whose step has a name of its own."""
    return v.objective.where("named") if "named" in v.objective.columns else v.objective


def dependency_edges(v: Views) -> DataFrame:
    """Distinct (quest_id, src, dst) from explicit dependencies; dep_no 0 means none."""
    return dependencies(v).select("quest_id", F.col("dep_no").alias("src"), F.col("step_no").alias("dst")).distinct()


def chain_edges(v: Views) -> DataFrame:
    """(quest_id, src, dst) between consecutive objectives, of all artifacts, as they hold where none declares a dependency."""
    w = Window.partitionBy("quest_id").orderBy("pos")
    steps = v.objective.select("quest_id", F.lag("step_no").over(w).alias("src"), F.col("step_no").alias("dst"))
    return steps.where("src is not null").distinct()


def missing_dependencies(v: Views) -> DataFrame:
    steps = stated_steps(v).select("quest_id", F.col("step_no").alias("dep_no")).distinct()
    return dependencies(v).where("explicit").join(steps, ["quest_id", "dep_no"], "left_anti").select("quest_id", "pos", "dep_no")


def edge_arrays(v: Views) -> DataFrame:
    """For each artifact with objectives: its nodes (phantoms included) and edges, as small arrays."""
    if v.dependency is not None:
        edges = v.dependency.groupBy("quest_id").agg(F.collect_set(F.struct(F.col("dep_no").alias("src"), F.col("step_no").alias("dst"))).alias("edges"))
        g = v.objective.groupBy("quest_id").agg(F.collect_set("step_no").alias("steps")).join(edges, "quest_id", "left")
        g = g.withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<src: string, dst: string>>)")))
        return g.select("quest_id", "edges", F.array_distinct(F.concat("steps", F.transform("edges", lambda e: e["src"]))).alias("nodes"))
    edge = F.when(F.col("dep_no") != 0, F.struct(F.col("dep_no").alias("src"), F.col("step_no").alias("dst")))
    g = v.objective.groupBy("quest_id").agg(F.collect_set("step_no").alias("steps"), F.collect_set(edge).alias("edges"))
    return g.select("quest_id", "edges", F.array_distinct(F.concat("steps", F.transform("edges", lambda e: e["src"]))).alias("nodes"))


def first_cycles(edges: Column, nodes: Column, most: int = CYCLES, named: bool = False) -> Column:
    """The first simple cycles, shorter ones first, then by their nodes; each starts at its least node. Edges know their nodes."""
    return array_graphs.first_cycles(edges, most, named)


def shown_cycles(cycles: Column, quoted: bool) -> Column:
    """Lists of nodes as text: [[1, 2], [3]], or with quotes where nodes are texts."""
    node = lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")) if quoted else x.cast("string")
    inside = lambda xs, show: F.concat(F.lit("["), F.array_join(F.transform(xs, show), ", "), F.lit("]"))
    return inside(cycles, lambda c: inside(c, node))


def _facts(arrays: DataFrame, named: bool) -> DataFrame:
    """See graph_facts; arrays: quest_id, nodes, edges."""
    g = arrays.withColumn("cyclic", array_graphs.cyclic(F.col("edges"), named))
    roots = F.array_sort(F.array_except("nodes", F.transform("edges", lambda e: e["dst"])))
    ends = F.array_sort(F.array_except("nodes", F.transform("edges", lambda e: e["src"])))
    return g.select("quest_id", "cyclic", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.when(~F.col("cyclic"), roots).alias("roots"), F.when(~F.col("cyclic"), ends).alias("terminals"), "nodes", "edges")


def graph_facts(v: Views, long: int = LONG) -> DataFrame:
    """quest_id, cyclic, n_nodes, n_edges, roots, terminals (arrays; null for cyclic graphs), nodes, edges.

    Graphs of JSON artifacts of more than long nodes go through long_graphs; objectives of tables are few."""
    every = edge_arrays(v)
    if v.dependency is None:
        return _facts(every, False)
    out = _facts(every.where(F.size("nodes") <= long), True)
    return out.unionByName(long_graphs.applied(every.where(F.size("nodes") > long), out.schema, long_graphs.facts))


def graph(v: Views, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Issues of dependency graphs; those of the graph as a whole come out of one pass over the artifacts' arrays.

    codes: what is asked for, if not all: nothing else is looked for."""
    asked = lambda code: codes is None or code in codes
    dependency = F.format_string("objectives[%d].depends_on", "pos")
    named, frames = v.dependency is not None, []
    if asked("MISSING_STEP_DEPENDENCY"):
        frames.append(_issue(missing_dependencies(v), "graph", "MISSING_STEP_DEPENDENCY", "error", dependency, F.col("dep_no")))
    if any(map(asked, WHOLE)):
        every = edge_arrays(v)
        few = _facts(every.where(F.size("nodes") <= LONG) if named else every, named)
        told = few
        if asked("CYCLIC_OBJECTIVE_DEPENDENCY"):
            told = told.withColumn("cycles", first_cycles(F.col("edges"), F.col("nodes"), CYCLES, named))
        if asked("UNREACHABLE_OBJECTIVE"):
            told = told.withColumn("lost", array_graphs.unreached(F.col("edges"), named))
        cycles = shown_cycles(F.col("cycles"), named) if "cycles" in told.columns else F.lit("")
        frames.append(told.select("quest_id", F.inline(whole_graph(cycles, "lost" in told.columns))))
        if named:
            judged = lambda g: {**long_graphs.facts(g), "cycles": g.shortest_cycles(CYCLES)}
            many = long_graphs.applied(every.where(F.size("nodes") > LONG), few.withColumn("cycles", F.array("nodes")).schema, judged)
            frames.append(many.select("quest_id", F.inline(whole_graph(shown_cycles(F.col("cycles"), named), reach=False))))
    if v.unlisted is not None and asked("INVALID_DEPENDENCY_LIST"):
        frames.append(_issue(v.unlisted, "graph", "INVALID_DEPENDENCY_LIST", "error", dependency, F.lit("")))
    issues = union(frames)
    return issues if codes is None else issues.where(F.col("code").isin(list(codes)))


def _one(validator: str, code: Column | str, severity: str, path: Column | str, detail: Column) -> Column:
    literal = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(validator).alias("validator"), literal(code).alias("code"), F.lit(severity).alias("severity"), literal(path).alias("path"), detail.cast("string").alias("detail"))


def whole_graph(cycles: Column, reach: bool = True) -> Column:
    """Issues of graphs as a whole (cyclic, roots: see graph_facts), as an array; cycles: their text.

    reach: whether nodes that no root leads to (lost) are told. A graph without cycles has none: going back from a node ends at a root."""
    none = F.expr("cast(array() as array<struct<validator: string, code: string, severity: string, path: string, detail: string>>)")
    issue = lambda code, severity, detail: _one("graph", code, severity, "objectives", detail)
    parts = [
        F.when(F.col("cyclic"), F.array(issue("CYCLIC_OBJECTIVE_DEPENDENCY", "error", cycles))).otherwise(none),
        F.when(F.size("roots") > 1, F.array(issue("MULTIPLE_OBJECTIVE_ROOTS", "warning", F.size("roots")))).otherwise(none),
    ]
    if reach:
        parts.append(F.when(~F.col("cyclic"), F.transform("lost", lambda node: issue("UNREACHABLE_OBJECTIVE", "error", node))).otherwise(none))
    return F.concat(*parts)


def structural(v: Views) -> DataFrame:
    """Issues of the referential and the graph gate together, without the text of cycles.

    Views of tables give each artifact's objectives as one array, with their targets looked up on the way: one pass over the objectives for
    both gates. Other views have arrays of their own, and are judged by both gates apart."""
    if v.dependency is not None or "named" in v.objective.columns:
        return union([referential(v), graph(v)])
    steps = judged_targets(v).groupBy("quest_id").agg(F.collect_list(F.struct("pos", "step_no", "dep_no", "target", "found")).alias("steps"))
    edges = F.array_distinct(F.transform(F.filter("steps", lambda s: s["dep_no"] != 0), lambda s: F.struct(s["dep_no"].alias("src"), s["step_no"].alias("dst"))))
    numbers = F.transform("steps", lambda s: s["step_no"])
    rows = steps.select("quest_id", "steps", numbers.alias("numbers"), edges.alias("edges"))
    rows = rows.withColumn("nodes", F.array_distinct(F.concat("numbers", F.transform("edges", lambda e: e["src"]))))
    rows = rows.withColumn("cyclic", array_graphs.cyclic(F.col("edges")))
    rows = rows.withColumn("roots", F.when(~F.col("cyclic"), F.array_except("nodes", F.transform("edges", lambda e: e["dst"]))))
    targets = F.transform(F.filter("steps", lambda s: s["found"].isNotNull()), lambda s: _one("referential", s["found"], "error", F.format_string("objectives[%d].target", s["pos"]), s["target"]))
    repeated = F.filter(F.array_distinct("numbers"), lambda n: F.size(F.filter("numbers", lambda m: m == n)) > 1)
    twice = F.transform(repeated, lambda n: _one("referential", "DUPLICATE_STEP_ID", "error", "objectives", n))
    gone = F.filter("steps", lambda s: (s["dep_no"] != 0) & ~F.array_contains("numbers", s["dep_no"]))
    missing = F.transform(gone, lambda s: _one("graph", "MISSING_STEP_DEPENDENCY", "error", F.format_string("objectives[%d].depends_on", s["pos"]), s["dep_no"]))
    return union([reference_issues(v), rows.select("quest_id", F.inline(F.concat(targets, twice, missing, whole_graph(F.lit(""), reach=False))))])


def graph_metrics(v: Views, long: int = LONG) -> DataFrame:
    """Node and edge counts, density, greatest shortest distance from a root, weak components and degree centrality."""
    every = edge_arrays(v).withColumns({"n_nodes": F.size("nodes").cast("long"), "n_edges": F.size("edges").cast("long")})
    f = every if v.dependency is None else every.where(F.size("nodes") <= long)
    n, m = F.col("n_nodes"), F.col("n_edges")
    roots = F.array_except("nodes", F.transform("edges", lambda e: e["dst"]))
    grow = lambda acc, _: F.struct(F.array_union(acc["seen"], F.transform(F.filter(F.col("edges"), lambda e: F.array_contains(acc["seen"], e["src"])), lambda e: e["dst"])).alias("seen"), (acc["depth"] + F.when(F.size(F.array_except(F.transform(F.filter(F.col("edges"), lambda e: F.array_contains(acc["seen"], e["src"])), lambda e: e["dst"]), acc["seen"])) > 0, 1).otherwise(0)).alias("depth"))
    depth = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.struct(roots.alias("seen"), F.lit(0).alias("depth")), grow)["depth"]
    both = F.concat("edges", F.transform("edges", lambda e: F.struct(e["dst"].alias("src"), e["src"].alias("dst"))))
    spread = lambda acc, _: F.transform_values(acc, lambda k, x: F.least(x, F.coalesce(F.array_min(F.transform(F.filter(both, lambda e: e["dst"] == k), lambda e: F.element_at(acc, e["src"]))), x)))
    labels = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.map_from_arrays("nodes", "nodes"), spread)
    degree = F.array_max(F.transform("nodes", lambda x: F.size(F.filter("edges", lambda e: e["src"] == x)) + F.size(F.filter("edges", lambda e: e["dst"] == x))))
    out = f.select("quest_id", "n_nodes", "n_edges", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), F.size(F.array_distinct(F.map_values(labels))).cast("long").alias("components"), depth.cast("long").alias("max_depth"), F.when(n > 1, degree / (n - 1)).otherwise(0.0).alias("max_degree_centrality"))
    return out if v.dependency is None else out.unionByName(long_graphs.applied(every.where(F.size("nodes") > long), out.schema, long_graphs.measures))


def _report(v: Views, issues: DataFrame, validators: tuple[str, ...], *more: Column) -> DataFrame:
    """See report; with more aggregates of each artifact's and validator's issues, so that issues are gathered once."""
    counts = issues.groupBy("quest_id", "validator").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), *more)
    grid = v.artifact.select("quest_id", F.explode(F.array(*map(F.lit, validators))).alias("validator"))
    zero = F.lit(0).cast("long")
    others = [c for c in counts.columns if c not in ("quest_id", "validator", "errors", "warnings")]
    full = grid.join(counts, ["quest_id", "validator"], "left")
    return full.select("quest_id", "validator", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (F.coalesce("errors", zero) == 0).alias("passed"), *others)


def report(v: Views, issues: DataFrame, validators: tuple[str, ...] = VALIDATORS) -> DataFrame:
    """A row for each artifact and validator, clean ones included; warnings do not fail."""
    return _report(v, issues, validators)


def report_rows(v: Views, issues: DataFrame, validators: tuple[str, ...] = VALIDATORS) -> DataFrame:
    """A row for each artifact and validator as it is published: passed, error_count, warning_count, and its issues in order."""
    told = F.sort_array(F.collect_list(F.struct("code", "severity", "path", "detail"))).alias("issues")
    none = F.expr("cast(array() as array<struct<code: string, severity: string, path: string, detail: string>>)")
    rows = _report(v, issues, validators, told)
    return rows.select("quest_id", "validator", "passed", F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count"), F.coalesce("issues", none).alias("issues"))


def combined(reports: DataFrame, validators: tuple[str, ...] = VALIDATORS) -> DataFrame:
    """One report for each artifact (of report_rows): the issues of all validators in their order, and the validators' names."""
    order = F.array_position(F.array(*map(F.lit, validators)), F.col("validator"))
    parts = F.sort_array(F.collect_list(F.struct(order.alias("k"), "validator", "issues")))
    total = lambda c: F.sum(c).cast("long").alias(c)
    rows = reports.groupBy("quest_id").agg(F.bool_and("passed").alias("passed"), total("error_count"), total("warning_count"), parts.alias("parts"))
    return rows.select("quest_id", "passed", "error_count", "warning_count", F.transform("parts", lambda s: s["validator"]).alias("validators"), F.flatten(F.transform("parts", lambda s: s["issues"])).alias("issues"))


def validator_summary(rows: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("validator").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), total("errors").alias("errors"), total("warnings").alias("warnings"))


def artifact_passes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("quest_id").agg(F.bool_and("passed").alias("passed"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
