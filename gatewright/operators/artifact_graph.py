"""The typed property graph of JSON artifacts, and its metrics, as small arrays of each artifact.

Nodes are the artifact, its entities (typed by the catalog, or implicit), objectives, actions, success conditions, rewards,
reward values and tags; a node that is given several types keeps the last. Edges are distinct pairs with the last relation. Reach and
components grow by whole frontiers, as often as the artifact has nodes at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..sources.artifacts import at, elements, numbered, shown, text
from .json_gates import settled

NODE, EDGE = "array<struct<node: string, type: string, label: string>>", "array<struct<src: string, dst: string, relation: string>>"


def _named(v: Column) -> Column:
    """A string that is not blank, stripped; else null."""
    s = py_strip(text(v))
    return F.when(s != "", s)


def parts(artifacts: DataFrame) -> DataFrame:
    """quest_id, seq, src, dst, relation, type, label (of dst; type null: an entity of the catalog, or fallback) in the order
    in which the graph is built. The row without src is the artifact itself."""
    v, q = F.col("v"), F.col("quest_id")
    row = lambda src, dst, relation, type_, label, fallback=None: F.struct(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(type_).alias("type"), label.alias("label"), F.lit(fallback).cast("string").alias("fallback"))
    none = F.lit(None).cast("string")
    made = [F.array(row(none, q, None, "quest", F.coalesce(shown(at(v, "title")), q)))]
    for key, relation in (("giver_npc", "given_by"), ("start_location", "starts_at")):
        made.append(F.array(row(q, _named(at(v, key)), relation, None, none, "implicit")))

    def objective(s: Column) -> Column:
        step = F.coalesce(shown(at(s["v"], "step_id")), F.format_string("step_%03d", s["pos"] + 1))
        node = F.concat_ws("::", q, step)
        action = _named(at(s["v"], "action"))
        own = [
            row(q, node, "has_objective", "objective", step),
            row(node, F.concat(F.lit("action::"), action), "uses_action", "action", action),
            row(node, _named(at(s["v"], "target")), "targets", None, none, "implicit"),
            row(node, F.concat(node, F.lit("::success")), "has_success_condition", "success_condition", F.coalesce(shown(at(s["v"], "success_condition")), F.lit("None"))),
        ]
        before = F.transform(elements(at(s["v"], "depends_on")), lambda d: row(F.concat_ws("::", q, shown(d)), node, "precedes", "objective", step))
        return F.concat(F.array(*own), before)

    made.append(F.flatten(F.transform(numbered(at(v, "objectives")), objective)))

    def reward(s: Column) -> Column:
        node = F.concat(q, F.lit("::reward_"), (s["pos"] + 1).cast("string"))
        return F.array(row(q, node, "rewards_with", "reward", F.coalesce(shown(at(s["v"], "type")), F.lit("reward"))), row(node, _named(at(s["v"], "value")), "has_value", None, none, "reward_value"))

    made.append(F.flatten(F.transform(numbered(at(v, "rewards")), reward)))
    made.append(F.transform(elements(at(v, "reusable_tags")), lambda t: row(q, F.concat(F.lit("tag::"), _named(t)), "has_tag", "tag", _named(t))))
    return artifacts.select("quest_id", F.posexplode(F.concat(*made)).alias("seq", "p")).select("quest_id", "seq", "p.*").where("dst IS NOT NULL")


def artifact_graph(artifacts: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (quest_id, node, type, label) and edges (quest_id, src, dst, relation) of keyed artifacts."""
    p = parts(artifacts)
    kinds = entity.select(F.col("entity_id").alias("dst"), "entity_type")
    to = p.join(kinds, "dst", "left").select("quest_id", "seq", F.col("dst").alias("node"), F.coalesce("type", "entity_type", "fallback").alias("type"), "label")
    dependency = p.where("relation = 'precedes'").select("quest_id", "seq", F.col("src").alias("node"), F.lit("objective").alias("type"), F.element_at(F.split("src", "::"), -1).alias("label"))
    last = lambda df, keys, *cols: df.groupBy("quest_id", *keys).agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("quest_id", *keys, "x.*")
    nodes = last(to.unionByName(dependency), ["node"], "type", "label")
    return nodes, last(p.where("src IS NOT NULL"), ["src", "dst"], "relation")


#: What counting reads: strings as binary, which takes strings only; given tells a step_id that is null from one that is missing.
STEP = "struct<step_id: string, action: binary, target: binary, depends_on: array<string>>"
READ = f"struct<giver_npc: binary, start_location: binary, objectives: array<{STEP}>, rewards: array<struct<value: binary>>, reusable_tags: array<binary>>"
GIVEN = "array<struct<step_id: variant>>"
#: Types of entities that the catalog does not know.
FALLBACK = ("implicit", "reward_value")


def typed_nodes(artifacts: DataFrame) -> DataFrame:
    """quest_id, nodes: node and type (null: an entity, whose type the catalog knows) of each node of an artifact, the last that it is given.

    As artifact_graph has them, but in each artifact's row: its nodes are its own, so that nothing is grouped."""
    q = F.col("quest_id")
    of = lambda node, type_: F.struct(node.alias("node"), F.lit(type_).cast("string").alias("type"))
    none = lambda x, type_: F.coalesce(x, F.expr(f"cast(array() as {type_})"))

    def name(x: Column) -> Column:
        s = py_strip(x.cast("string"))
        return F.when(s != "", s)

    def objective(s: Column, i: Column) -> Column:
        given = F.get(F.col("given"), i)["step_id"]
        step = F.coalesce(s["step_id"], F.when(given.isNotNull(), "None"), F.format_string("step_%03d", i + 1))
        node = F.concat_ws("::", q, step)
        own = F.array(of(node, "objective"), of(F.concat(F.lit("action::"), name(s["action"])), "action"), of(name(s["target"]), None), of(F.concat(node, F.lit("::success")), "success_condition"))
        # A dependency makes the step and the one before it objectives once more; a null is shown as None.
        before = F.flatten(F.transform(none(s["depends_on"], "array<string>"), lambda d: F.array(of(node, "objective"), of(F.concat_ws("::", q, F.coalesce(d, F.lit("None"))), "objective"))))
        return F.when(s.isNotNull(), F.concat(own, before)).otherwise(F.expr("cast(array() as array<struct<node: string, type: string>>)"))

    rewards = F.transform(none(F.col("x.rewards"), "array<struct<value: binary>>"), lambda r, i: F.when(r.isNotNull(), F.array(of(F.concat(q, F.lit("::reward_"), (i + 1).cast("string")), "reward"), of(name(r["value"]), None))))
    tags = F.transform(none(F.col("x.reusable_tags"), "array<binary>"), lambda t: of(F.concat(F.lit("tag::"), name(t)), "tag"))
    core = F.array(of(q, "quest"), *[of(name(F.col(f"x.{k}")), None) for k in ("giver_npc", "start_location")])
    made = F.concat(core, F.flatten(F.transform(none(F.col("x.objectives"), f"array<{STEP}>"), objective)), F.flatten(F.array_compact(rewards)), tags)
    there = F.transform(F.filter(made, lambda n: n["node"].isNotNull()), lambda n, i: F.struct(n["node"].alias("node"), i.alias("seq"), n["type"].alias("type")))
    rows = settled(artifacts.select("quest_id", "v"), x=F.try_variant_get("v", "$", READ), given=F.try_variant_get("v", "$.objectives", GIVEN))
    rows = settled(rows, every=F.array_sort(there))
    last = F.transform("every", lambda n, i: F.when(~n["node"].eqNullSafe(F.get(F.col("every"), i + 1)["node"]), F.struct(n["node"].alias("node"), n["type"].alias("type"))))
    return settled(rows, nodes=F.array_compact(last)).select("quest_id", "nodes")


def type_counts(artifacts: DataFrame, entity: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """quest_id and <type>_count of each type: how many nodes of an artifact have it.

    Entities go to the catalog only where it has some of these types, and then only to those; other entities' nodes count nowhere."""
    if set(types) & set(FALLBACK):
        nodes, _ = artifact_graph(artifacts, entity)
        return nodes.groupBy("quest_id").agg(*[F.count_if(F.col("type") == t).alias(f"{t}_count") for t in types])
    rows = typed_nodes(artifacts)
    own = [F.size(F.filter("nodes", _has(t))).cast("long").alias(f"{t}_count") for t in types]
    kinds = entity.where(F.col("entity_type").isin(*types)).select(F.col("entity_id").alias("node"), "entity_type")
    if kinds.isEmpty():
        return rows.select("quest_id", *own)
    open_ = rows.select("quest_id", F.explode(F.transform(F.filter("nodes", lambda n: n["type"].isNull()), lambda n: n["node"])).alias("node"))
    more = open_.join(kinds, "node").groupBy("quest_id").agg(*[F.count_if(F.col("entity_type") == t).alias(f"more_{t}") for t in types])
    return rows.select("quest_id", *own).join(more, "quest_id", "left").select("quest_id", *[(F.col(f"{t}_count") + F.coalesce(f"more_{t}", F.lit(0).cast("long"))).alias(f"{t}_count") for t in types])


def _has(type_: str) -> Callable[[Column], Column]:
    return lambda n: n["type"] == type_


def graph_metrics(artifacts: DataFrame, entity: DataFrame) -> DataFrame:
    """Counts, density, weak components, depth from the artifact, counts by type, references and centrality of each artifact."""
    nodes, edges = artifact_graph(artifacts, entity)
    known = nodes.join(entity.select(F.col("entity_id").alias("node"), F.lit(True).alias("known")).distinct(), "node", "left")
    count = lambda t: F.count_if(F.col("type") == t).alias(f"{'implicit_node' if t == 'implicit' else t}_count")
    n = known.groupBy("quest_id").agg(F.count("*").alias("node_count"), *map(count, ("objective", "action", "reward", "tag", "implicit")), F.count_if("known").alias("world_reference_count"), F.collect_list("node").alias("nodes"))
    e = edges.groupBy("quest_id").agg(F.count("*").alias("edge_count"), F.collect_list(F.struct("src", "dst")).alias("edges"))
    ends = edges.select("quest_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("quest_id", "node").count().groupBy("quest_id").agg(F.max("count").alias("degree"))
    g = n.join(e, "quest_id", "left").join(ends, "quest_id", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<src: string, dst: string>>)")))
    both = F.concat("edges", F.transform("edges", lambda x: F.struct(x["dst"].alias("src"), x["src"].alias("dst"))))
    turns = F.sequence(F.lit(1), F.size("nodes"))

    def spread(seen: Column, links: Column) -> Column:
        return F.array_union(seen, F.transform(F.filter(links, lambda x: F.array_contains(seen, x["src"])), lambda x: x["dst"]))

    def deeper(acc: Column, _: Column) -> Column:
        now = spread(acc["seen"], F.col("edges"))
        return F.struct(now.alias("seen"), (acc["depth"] + F.when(F.size(now) > F.size(acc["seen"]), 1).otherwise(0)).alias("depth"))

    depth = F.aggregate(turns, F.struct(F.array("quest_id").alias("seen"), F.lit(0).alias("depth")), deeper)["depth"]

    def component(acc: Column, node: Column) -> Column:
        whole = F.aggregate(turns, F.array(node), lambda seen, _: spread(seen, F.col("both")))
        return F.when(F.array_contains(acc["seen"], node), acc).otherwise(F.struct(F.array_union(acc["seen"], whole).alias("seen"), (acc["k"] + 1).alias("k")))

    empty = F.struct(F.expr("cast(array() as array<string>)").alias("seen"), F.lit(0).alias("k"))
    g = g.withColumn("both", both).withColumn("connected_components", F.aggregate("nodes", empty, component)["k"])
    m, edge_count = F.col("node_count"), F.coalesce("edge_count", F.lit(0)).cast("long")
    share = lambda c: F.col(c) / m
    many = m > 1
    return g.select(
        "quest_id", "node_count", edge_count.alias("edge_count"), F.when(many, edge_count / (m * (m - 1))).otherwise(0.0).alias("density"), "connected_components", depth.alias("max_depth"),
        "objective_count", "action_count", "reward_count", "tag_count", "world_reference_count", share("world_reference_count").alias("world_reference_rate"), "implicit_node_count",
        share("implicit_node_count").alias("implicit_entity_rate"), F.when(many, F.coalesce("degree", F.lit(0)) / (m - 1)).otherwise(1.0).alias("max_degree_centrality"),
    )
