"""The four gates over JSON artifacts in one pass, where what they say is counted and not shown.

Each artifact is read once, into typed fields. What it can be told alone is counted in its row: schema, repeated steps, graph, content. Its
references go to the catalog as rows, each looked up once for all gates; a row with the counts goes along, so that artifacts are built and
read once. Results are those of the gates that give issue rows (schema_gate, gates, content_gate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, step_name
from . import array_graphs
from .content import CLEAR_LENGTH, GENERIC, WEAK, says
from .schema_gate import count_of

#: What the gates read, as types. Where a value must be a string, it is read as binary, which takes strings only; a missing value is null.
STEP = "struct<step_id: string, action: binary, target: binary, depends_on: array<string>, success_condition: string>"
REWARD = "struct<type: binary, value: binary>"
READ = f"struct<giver_npc: binary, start_location: binary, objectives: array<{STEP}>, rewards: array<{REWARD}>, completion_conditions: array<string>, preconditions: array<string>>"
TEXTS = "cast(array() as array<string>)"
#: Lists up to which each dependency is looked for among the steps one by one.
SHORT = 200
#: Edges up to which a graph is judged by an expression.
FEW = 16


def _listed(x: Column, type_: str) -> Column:
    return F.coalesce(x, F.expr(f"cast(array() as array<{type_}>)"))


def settled(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with columns that are evaluated here, once: what reads them does not repeat them, and Arrow functions get them as they are."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def read(artifacts: DataFrame) -> DataFrame:
    """artifacts (quest_id, v) with x (the fields that gates read), raw (all elements of objectives, null where they are no objects), given
    (their dependencies as they are), and o: the objects among them: pos (in raw), own (the step's own name), name, deps (null: no list), action, target."""
    rows = settled(artifacts.select("quest_id", "v"), x=F.try_variant_get("v", "$", READ), given=_listed(F.try_variant_get("v", "$.objectives", "array<struct<depends_on: variant>>"), "struct<depends_on: variant>"))
    rows = settled(rows, raw=_listed(F.col("x.objectives"), STEP))
    some = lambda s, i: F.when(s.isNotNull(), F.struct(i.cast("long").alias("pos"), s.alias("s")))

    def named(t: Column, i: Column) -> Column:
        own = t["s"]["step_id"]
        name = F.when(own != "", own).otherwise(step_name((i + 1).cast("long")))
        return F.struct(t["pos"].alias("pos"), own.alias("own"), name.alias("name"), t["s"]["depends_on"].alias("deps"), t["s"]["action"].alias("action"), t["s"]["target"].alias("target"))

    return settled(rows, o=F.transform(F.array_compact(F.transform("raw", some)), named))


def odd_lists() -> Column:
    """How many objectives have dependencies that are neither a list nor null."""
    lists = F.transform("raw", lambda s: s["depends_on"].isNotNull())
    return F.size(F.filter(F.transform("given", lambda g, i: F.coalesce(g["depends_on"].isNotNull() & ~F.get(lists, i) & (F.schema_of_variant(g["depends_on"]) != "VOID"), F.lit(False))), lambda odd: odd))


def unclear() -> Column:
    """How many objectives' success conditions are short. A JSON null is shown as None, which is as short as a missing one."""
    said = lambda s: F.coalesce(s["success_condition"], F.lit(""))
    return F.size(F.filter("raw", lambda s: s.isNotNull() & ((F.length(said(s)) < CLEAR_LENGTH) | (F.length(py_strip(said(s))) < CLEAR_LENGTH))))


def own_names(o: Column) -> Column:
    return F.filter(F.transform(o, lambda s: s["own"]), lambda n: F.coalesce(n, F.lit("")) != "")


def stated(o: Column) -> Column:
    """All dependencies that objectives list."""
    return F.flatten(F.transform(o, lambda s: F.coalesce(s["deps"], F.expr(TEXTS))))


def edges(o: Column) -> Column:
    """Distinct edges: what objectives list, or where none has a list, each after the one before. o is a column: it is named for each step."""
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    listed = F.flatten(F.transform(o, lambda s: F.transform(F.coalesce(s["deps"], F.expr(TEXTS)), lambda d: pair(d, s["name"]))))
    chain = F.filter(F.transform(o, lambda s, i: pair(F.get(o, i - 1)["name"], s["name"])), lambda e: e["src"].isNotNull())
    return F.array_distinct(F.when(F.exists(o, lambda s: s["deps"].isNotNull()), listed).otherwise(chain))


def repeats(names: Column) -> Column:
    """How many names occur more than once."""
    inorder = F.array_sort(names)
    again = F.filter(F.transform(inorder, lambda n, i: F.when(n == F.get(inorder, i - 1), n)), lambda n: n.isNotNull())
    return F.when(F.size(F.array_distinct(names)) == F.size(names), 0).otherwise(F.size(F.array_distinct(again)))


def missing(deps: Column, names: Column) -> Column:
    """How many dependencies are no step's own name; each counts, and so does a null. Null for long lists (see array_graphs.absent)."""
    lost = F.array_except(deps, names)
    each = F.filter(deps, lambda d: d.isNull() | ~F.array_contains(names, d))
    return F.when(F.size(lost) == 0, 0).when(F.size(F.array_distinct(deps)) == F.size(deps), F.size(lost)).when(F.size(deps) <= SHORT, F.size(each))


def few_cyclic(found: Column) -> Column:
    """Whether edges have a cycle: those that nothing leads to are taken away, again and again. Null for long lists (see array_graphs.cyclic)."""
    known = F.filter(found, lambda e: e["src"].isNotNull())
    led = lambda es: F.get(F.transform(F.array(F.transform(es, lambda e: e["dst"])), lambda ends: F.filter(es, lambda e: F.array_contains(ends, e["src"]))), F.lit(0))
    left = F.aggregate(F.sequence(F.lit(1), F.size(found)), known, lambda es, _: led(es))
    return F.when(F.size(found) == 0, False).when(F.size(found) <= FEW, F.size(left) > 0)


def with_cyclic(rows: DataFrame, **of: str) -> DataFrame:
    """rows with whether the edges of a column (named by each new column's argument) have a cycle; only long lists go to Arrow functions."""
    few = settled(rows, **{f"few_{name}": few_cyclic(F.col(c)) for name, c in of.items()}, **{f"long_{name}": F.when(F.size(c) > FEW, F.col(c)) for name, c in of.items()})
    long = few.withColumns({f"far_{name}": array_graphs.cyclic(F.col(f"long_{name}"), True) for name in of} | ({"absent": array_graphs.absent("long_stated", "long_names")} if "long_stated" in rows.columns else {}))
    return long.withColumns({name: F.coalesce(f"few_{name}", f"far_{name}") for name in of})


def roots(o: Column, found: Column) -> Column:
    """How many nodes no edge leads to."""
    nodes = F.concat(F.transform(o, lambda s: s["name"]), F.transform(found, lambda e: e["src"]))
    return F.size(F.array_except(nodes, F.transform(found, lambda e: e["dst"])))


def hits(texts: Column, patterns: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.coalesce(texts, F.expr(TEXTS)), lambda t: says(F.coalesce(t, F.lit("None")), patterns)))


def with_edges(rows: DataFrame) -> DataFrame:
    o = F.col("o")
    return settled(rows, edges=edges(o), names=own_names(o), stated=stated(o))


def counts(artifacts: DataFrame, refs: Column, schema: dict) -> DataFrame:
    """quest_id, refs, and alone: errors and warnings of each artifact (quest_id, v) that it can be told without the catalog."""
    of = lambda test: F.when(test, 1).otherwise(0)
    rows = with_edges(read(artifacts)).select(
        "quest_id", refs.alias("refs"), "edges", missing(F.col("stated"), F.col("names")).alias("missing"), *[F.when(F.size("stated") > SHORT, F.col(c)).alias(f"long_{c}") for c in ("stated", "names")], odd_lists().alias("odd"),
        roots(F.col("o"), F.col("edges")).alias("roots"), F.when(F.col("v").isNotNull(), count_of(F.col("v"), schema)).otherwise(0).alias("schema"), repeats(F.col("names")).alias("repeats"),
        hits(F.col("x.completion_conditions"), GENERIC).alias("generic"), (hits(F.col("x.preconditions"), WEAK) + unclear()).alias("weak"),
    )
    rows = with_cyclic(rows, cyclic="edges")
    graph = F.coalesce("missing", F.col("absent").cast("int")) + of(F.col("cyclic")) + F.col("odd")
    told = {"schema_errors": F.col("schema"), "referential_errors": F.col("repeats"), "graph_errors": graph, "graph_warnings": of(~F.col("cyclic") & (F.col("roots") > 1)), "content_errors": F.col("generic"), "content_warnings": F.col("weak")}
    return rows.select("quest_id", "refs", F.struct(*[c.cast("int").alias(name) for name, c in told.items()]).alias("alone"))


class Wanted:
    """Which types a reference may have: places of pairs (number of what is wanted, type); 0 wants any type."""

    CORE = {"giver_npc": ("npc",), "start_location": ("location",), "rewards": ("item",)}

    def __init__(self, compat: dict[str, tuple[str, ...]]) -> None:
        actions: dict[str, set[str]] = {}
        for a, types in compat.items():
            if types:
                actions.setdefault(a.lower(), set()).update(types)
        self.keys = [*self.CORE, *(f"={a}" for a in actions)]
        every = {**self.CORE, **{f"={a}": ts for a, ts in actions.items()}}
        self.pairs = [f"{i + 1}:{t}" for i, k in enumerate(self.keys) for t in sorted(every[k])]

    def number(self, key: str) -> Column:
        return F.lit(self.keys.index(key) + 1)

    def of_action(self, action: Column) -> Column:
        known = F.concat(F.lit("="), F.lower(py_strip(action)))
        return F.coalesce(F.array_position(F.array(*map(F.lit, self.keys)), known), F.lit(0)).cast("int")

    def unfit(self, want: Column, type_: Column) -> Column:
        return (want > 0) & ~F.concat_ws(":", want.cast("string"), type_).isin(self.pairs)


def references(wanted: Wanted) -> Column:
    """An artifact's references: ref, want (null: what its action wants), action, at (an objective's place among all elements, or -1)."""
    one = lambda ref, want, action, at: F.struct(ref.cast("string").alias("ref"), want.cast("int").alias("want"), action.cast("string").alias("action"), at.cast("long").alias("at"))
    none, outside = F.lit(None), F.lit(-1)
    core = F.array(*[one(F.col(f"x.{k}"), wanted.number(k), none, outside) for k in ("giver_npc", "start_location")])
    rewards = F.filter(_listed(F.col("x.rewards"), REWARD), lambda r: r["type"].cast("string") == "item")
    items = F.transform(rewards, lambda r: one(r["value"], wanted.number("rewards"), none, outside))
    return F.concat(core, items, F.transform("o", lambda s: one(s["target"], none, s["action"], s["pos"])))


def looked_up(rows: DataFrame, wanted: Wanted, entity: DataFrame) -> DataFrame:
    """A row for each artifact (quest_id, alone) and one for each of its references that is not blank (quest_id, want, at, and type: that of the
    catalog, or null); rows: quest_id, refs (see references) and alone."""
    kind = rows.schema["alone"].dataType.simpleString()
    base = F.struct(F.coalesce("quest_id", F.lit("")).alias("ref"), F.lit(None).cast("int").alias("want"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("long").alias("at"), "alone")
    each = F.concat(F.array(base), F.transform("refs", lambda r: F.struct(*[r[c].alias(c) for c in ("ref", "want", "action", "at")], F.expr(f"cast(null as {kind})").alias("alone"))))
    flat = rows.select("quest_id", F.inline(each))
    want = F.when(F.col("alone").isNull(), F.coalesce("want", wanted.of_action(F.col("action"))))
    flat = flat.select("quest_id", py_strip(F.col("ref")).alias("key"), want.alias("want"), "at", "alone").where("want is null or key != ''")
    e = entity.select(F.col("entity_id").alias("_id"), F.col("entity_type").alias("type"))
    return flat.join(e, (F.col("key") == F.col("_id")) & F.col("want").isNotNull(), "left").drop("key", "_id")


def report(artifacts: DataFrame, entity: DataFrame, schema: dict, compat: dict[str, tuple[str, ...]]) -> DataFrame:
    """quest_id, validator, errors, warnings: a row for each artifact and gate, clean ones included."""
    wanted = Wanted(compat)
    known = looked_up(counts(artifacts, references(wanted), schema), wanted, entity)
    wrong = F.col("want").isNotNull() & (F.col("type").isNull() | wanted.unfit(F.col("want"), F.col("type")))
    names = known.schema["alone"].dataType.names
    rows = known.select("quest_id", "alone.*", F.col("alone").isNotNull().alias("own"), wrong.alias("wrong")).where("own or wrong")
    rows = rows.groupBy("quest_id").agg(F.count_if("own").cast("int").alias("n"), F.count_if("wrong").alias("wrong"), *[F.sum(c).alias(c) for c in names])
    # An artifact without a name has no issues that could be told to be its own.
    told = lambda c: F.when(F.col("quest_id").isNotNull(), c).otherwise(0).cast("long")
    one = lambda name, errors, warnings: F.struct(F.lit(name).alias("validator"), told(errors).alias("errors"), told(warnings).alias("warnings"))
    zero = F.lit(0)
    gates = F.array(
        one("schema", F.col("schema_errors"), zero), one("referential", F.col("referential_errors") + F.col("wrong"), zero),
        one("graph", F.col("graph_errors"), F.col("graph_warnings")), one("content", F.col("content_errors"), F.col("content_warnings")),
    )
    # Artifacts that share a name share their counts, and each has its rows.
    return rows.select("quest_id", F.inline(F.when(F.col("n") == 1, gates).otherwise(F.flatten(F.array_repeat(gates, F.col("n"))))))
