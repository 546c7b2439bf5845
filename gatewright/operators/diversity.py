"""Structural diversity of a set of artifacts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import py_strip
from ..sources.scratch import keep
from ..sources.views import Views
from .array_graphs import cyclic
from .gates import union

#: Distinct feature sets of a block, and features that are compared at once, where all pairs are formed.
BLOCK, FEATURES = 2000, 4096
#: Sets of so many features at most are met by the subsets that they share; others in pairs of blocks.
FEW = 16
#: What is counted of a row of evolving; kinds of uses are their places here.
KINDS = ("signature_uses", "component_uses", "entity_uses")


def signatures(v: Views) -> DataFrame:
    """quest_id, ord, signature of each artifact (action:type in objective order; '' without objectives), and its tags where the views have them."""
    e = v.entity.select(F.col("entity_id").alias("_id"), "entity_type")
    action = "shown" if "shown" in v.objective.columns else "action"
    part = F.concat_ws(":", F.coalesce(F.lower(py_strip(F.col(action))), F.lit("unknown")), F.coalesce("entity_type", F.lit("unknown")))
    steps = v.objective.join(e, py_strip(F.col("target")) == F.col("_id"), "left").select("quest_id", F.struct("pos", part.alias("p")).alias("s"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]), " -> ")
    own = [c for c in ("quest_id", "ord", "tags") if c in v.artifact.columns]
    signed = v.artifact.select(own).join(steps.groupBy("quest_id").agg(text.alias("signature")), "quest_id", "left")
    return signed.select("quest_id", "ord", F.coalesce("signature", F.lit("")).alias("signature"), *own[2:])


def references(v: Views) -> DataFrame:
    """quest_id, entity_id of all references that exist, repeats kept."""
    refs = union([v.artifact.select("quest_id", F.col("giver").alias("ref")), v.artifact.select("quest_id", F.col("start").alias("ref")), v.objective.select("quest_id", F.col("target").alias("ref")), v.reward.where("type = 'item'").select("quest_id", F.col("value").alias("ref"))])
    return refs.join(v.entity.select(F.col("entity_id").alias("_id")), py_strip(F.col("ref")) == F.col("_id"), "left_semi").select("quest_id", F.col("ref").alias("entity_id"))


def described(v: Views) -> DataFrame:
    """quest_id, signature, entities (repeats kept), cyclic of each artifact that has references or objectives, of views whose objectives have their
    dep_no.

    They are those of signatures, references and gates.graph_facts, but all references are looked up in one join, where the catalog is the hashed side,
    and an artifact's are gathered once. Rows are dealt by artifact before that: artifacts are in pieces until then, which would be gathered in vain."""
    place = "place" if "place" in v.objective.columns else "pos"
    done = F.coalesce(F.lower(py_strip(F.col("action"))), F.lit("unknown"))
    steps = v.objective.select("quest_id", F.col("target").alias("ref"), F.col(place).alias("place"), done.alias("done"), "step_no", "dep_no")
    others = union([v.artifact.select("quest_id", F.col("giver").alias("ref")), v.artifact.select("quest_id", F.col("start").alias("ref")), v.reward.where("type = 'item'").select("quest_id", F.col("value").alias("ref"))])
    refs = steps.unionByName(others.where("ref IS NOT NULL"), allowMissingColumns=True).where("quest_id IS NOT NULL")
    e = v.entity.select(F.col("entity_id").alias("_id"), "entity_type").hint("shuffle_hash")
    known = refs.join(e, py_strip(F.col("ref")) == F.col("_id"), "left")
    part = F.when(F.col("done").isNotNull(), F.concat_ws(":", "done", F.coalesce("entity_type", F.lit("unknown"))))
    row = F.struct("place", part.alias("part"), "step_no", "dep_no", F.when(F.col("_id").isNotNull(), F.col("ref")).alias("entity"))
    told = known.select("quest_id", row.alias("row")).repartition("quest_id").groupBy("quest_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    some = lambda c: F.transform(F.filter("rows", lambda r: r[c].isNotNull()), lambda r: r[c])
    edges = F.transform(F.filter("rows", lambda r: r["dep_no"] != 0), lambda r: F.struct(r["dep_no"].alias("src"), r["step_no"].alias("dst")))
    return told.select("quest_id", F.array_join(some("part"), " -> ").alias("signature"), some("entity").alias("entities"), cyclic(edges).alias("cyclic"))


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: entropy over the natural logarithm of the number of observed categories; 0 for one or none."""
    s = counts.agg(F.sum(n).alias("t"), F.sum(F.col(n) * F.ln(n)).alias("x"), F.count("*").alias("k"))
    return s.select(F.coalesce(F.when(F.col("k") > 1, (F.ln("t") - F.col("x") / F.col("t")) / F.ln("k")), F.lit(0.0)).alias("entropy"))


def duplicate_rate(sigs: DataFrame) -> DataFrame:
    """One row: distinct signatures, and the share of artifacts whose signature another one has."""
    c = sigs.groupBy("signature").count()
    return c.agg(F.count("*").alias("unique_signatures"), F.coalesce(F.try_divide(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).cast("double"), F.sum("count")), F.lit(0.0)).alias("duplicate_rate"))


def usage(v: Views) -> DataFrame:
    return references(v).groupBy("entity_id").agg(F.count("*").alias("uses"))


def coverage(v: Views) -> DataFrame:
    """One row: references, entities used (under their ids as the catalog writes them), coverage of the catalog, concentration
    on the most used."""
    as_written = v.entity.select("entity_id", F.lit(True).alias("known")).distinct()
    u = usage(v).join(as_written, "entity_id", "left").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("refs"), F.count_if("known").alias("used"), F.max("uses").alias("most"))
    w = v.entity.agg(F.count("*").alias("world"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return u.crossJoin(w).select("refs", "used", ratio("used", "world").alias("coverage"), ratio("most", "refs").alias("concentration"))


def feature_sets(sigs: DataFrame) -> DataFrame:
    """quest_id, features: the components of an artifact's signature and its tags (where sigs has them), each once, sorted."""
    parts = F.split("signature", " -> ")
    return sigs.select("quest_id", F.array_sort(F.array_distinct(F.concat("tags", parts) if "tags" in sigs.columns else parts)).alias("features"))


def _pairs_of_blocks(key: tuple, table: pa.Table) -> pa.Table:
    """The sum over all pairs of two blocks' sets (or of one block's) of multiplicities times similarity."""
    block, m, features = (table[c].combine_chunks() for c in ("block", "m", "features"))
    low, high = (k.as_py() for k in key)
    sizes, of = np.diff(features.offsets.to_numpy()), block.to_numpy()
    code = features.flatten().dictionary_encode().indices.to_numpy() if len(features) else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(features)), sizes)
    sides = [np.flatnonzero(of == low), np.flatnonzero(of == high)]
    common = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    top = int(code.max(initial=-1)) + 1
    for at in range(0, top, FEATURES):
        some = (code >= at) & (code < at + FEATURES)
        bits = np.zeros((len(features), min(FEATURES, top - at)), np.float32)
        bits[row[some], code[some] - at] = 1
        common += bits[sides[0]] @ bits[sides[1]].T
    size, weight = (sizes.astype(np.float32), m.to_numpy().astype(np.float64))
    joined = size[sides[0]][:, None] + size[sides[1]][None, :] - common
    similar = common / np.maximum(joined, 1)
    if low == high:
        similar = np.triu(similar, 1)
    return pa.table({"total": [float(weight[sides[0]] @ similar.astype(np.float64) @ weight[sides[1]])]})


def _shared_by_subsets(sets: DataFrame, few: int) -> DataFrame:
    """One row: the sum over all pairs of distinct sets (features, m; few features at most) of multiplicities times similarity.

    A pair with k features in common shares C(k, j) subsets of j features, so the products of how often each subset occurs, summed by its size,
    give the number of pairs by common features exactly. Similarity asks for these and for both sizes' sum (u) only."""
    spark = sets.sparkSession
    sets = sets.withColumnRenamed("features", "own")
    known = keep(sets.select(F.explode("own").alias("f")).distinct(), "features")
    width = max(1, (known.count().bit_length() + 7) // 8)
    numbered = known.rdd.zipWithIndex().map(lambda x: (x[0].f, x[1])).toDF("f string, number long")
    name = F.unhex(F.lpad(F.hex("number"), 2 * width, "0")).alias("name")
    # A row's number is taken before its features are: together, each feature would get one.
    each = sets.withColumn("row", F.monotonically_increasing_id()).select("row", "m", F.explode("own").alias("f"))
    named = each.join(numbered.select(F.col("f").alias("_f"), name), F.col("f").eqNullSafe(F.col("_f")))
    rows = named.groupBy("row").agg(F.first("m").alias("m"), F.array_sort(F.collect_list("name")).alias("names"))
    subsets = F.aggregate("names", F.array(F.unhex(F.lit(""))), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, x))))
    dealt = rows.select("m", F.size("names").alias("size"), F.explode(subsets).alias("subset")).where(F.length("subset") > 0)
    held = dealt.groupBy("subset", "size").agg(F.sum("m").alias("c")).groupBy("subset").agg(F.collect_list(F.struct("size", "c")).alias("held"))
    exact = lambda x: x["c"].cast("decimal(18,0)")
    products = F.flatten(F.transform("held", lambda a: F.transform("held", lambda b: F.struct((a["size"] + b["size"]).alias("u"), (exact(a) * exact(b)).alias("c")))))
    met = held.select((F.length("subset") / width).cast("int").alias("j"), F.inline(products)).groupBy("j", "u").agg(F.sum("c").cast("decimal(38,0)").alias("c"))
    signs = spark.createDataFrame([(j, k, (-1) ** (j - k) * math.comb(j, k)) for j in range(1, few + 1) for k in range(1, j + 1)], "j int, k int, sign int")
    pairs = met.join(F.broadcast(signs), "j").groupBy("u", "k").agg(F.sum(F.col("c") * F.col("sign")).alias("n"))
    similar = F.sum(F.col("n").cast("double") * F.col("k") / (F.col("u") - F.col("k")))
    itself = sets.where(F.size("own") > 0).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("itself"))
    return pairs.agg(similar.alias("all")).crossJoin(F.broadcast(itself)).select(F.coalesce((F.col("all") - F.col("itself")) / 2, F.lit(0.0)).alias("total"))


def pairwise_similarity(sets: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row: mean Jaccard similarity over all pairs of sets (quest_id, features); 0 for fewer than two.

    Equal sets count by their number, so pairs are those of distinct sets. Those of few features are met by the subsets that they share: work
    grows with the sets, not with their pairs. Where a set has more, it is dealt into blocks; each pair of its block and any
    block is a task of its own that compares its sets as bit vectors and returns one number. No pair becomes a row."""
    d = keep(sets.groupBy("features").agg(F.count("*").alias("m")), "sets")
    large = F.size("features") > few
    some = d.agg(F.count_if(large).alias("large"), F.count_if(~large).alias("small")).first()
    blocks, rest = -(-some.large // block), -(-some.small // block)
    parts = []
    if some.small:
        parts.append(_shared_by_subsets(d.where(~large), few))
    if some.large:
        # Large sets have the first numbers; small ones meet their blocks only.
        own = F.when(large, F.pmod(F.xxhash64("features"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("features"), F.lit(max(rest, 1))) + blocks).cast("int")
        other = F.explode(F.when(large, F.sequence(F.lit(0), F.lit(blocks + rest - 1))).otherwise(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = d.select("m", "features", own.alias("block"), other.alias("other")).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        parts.append(dealt.drop("other").groupBy("low", "high").applyInArrow(_pairs_of_blocks, "total double"))
    none = d.sparkSession.createDataFrame([], "total double")
    cross = union([none, *parts]).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("cross"))
    same = d.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("same"))
    mean = (F.col("same") + F.col("cross")) / (F.col("n") * (F.col("n") - 1) / 2)
    return same.crossJoin(F.broadcast(cross)).select(F.coalesce(F.when(F.col("n") > 1, mean), F.lit(0.0)).alias("similarity"))  # of one row each


def set_metrics(v: Views) -> DataFrame:
    sigs = keep(signatures(v), "signatures")
    types = v.artifact.groupBy("quest_type").agg(F.count("*").alias("n"))
    return v.artifact.agg(F.count("*").alias("quest_count")).crossJoin(entropy(types)).crossJoin(duplicate_rate(sigs)).crossJoin(coverage(v).select("coverage", "concentration")).crossJoin(pairwise_similarity(feature_sets(sigs)))


def registered_first(judged: DataFrame, earlier: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """judged rows with signature ('' for null), name (the id, stripped) and registered: passed, and no row before it in order registered its
    name, nor had an earlier run (set_id, name) done so."""
    rows = judged.withColumn("signature", F.coalesce("signature", F.lit(""))).withColumn("name", F.trim(F.coalesce("quest_id", F.lit(""))))
    first = Window.partitionBy("name", "set_id", F.when(F.col("name") == "", F.col(order))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("passed") & ((F.col("name") == "") | (F.coalesce(F.sum(F.col("passed").cast("int")).over(first), F.lit(0)) == 0))
    rows = rows.withColumn("registered", F.coalesce(new, F.lit(False)))
    if earlier is None:
        return rows
    known = earlier.select("set_id", "name", F.lit(True).alias("known")).distinct()
    return rows.join(known, ["set_id", "name"], "left").withColumn("registered", F.col("registered") & F.col("known").isNull()).drop("known")


def used(rows: DataFrame, order: str = "ord") -> DataFrame:
    """set_id, (order), registered, kind (of KINDS), x: a row for each component and each entity of rows of registered_first, repeats kept."""
    each = lambda kind, xs: rows.select("set_id", order, "registered", F.lit(kind).cast("byte").alias("kind"), F.explode(xs).alias("x"))
    return each(1, F.split("signature", " -> ")).where("x != ''").unionByName(each(2, F.col("entities")))


def signed(rows: DataFrame, order: str = "ord") -> DataFrame:
    """set_id, (order), ord, quest_id, signature, registered, kind, x: rows of registered_first as uses of their signatures."""
    own = dict.fromkeys(("set_id", order, "ord", "quest_id", "signature", "registered"))
    return rows.select(*own, F.lit(0).cast("byte").alias("kind"), F.col("signature").alias("x"))


def evolving(judged: DataFrame) -> DataFrame:
    """set_id, ord, quest_id, signature, registered, and the uses of its signature, its components and its entities before it, of judged
    rows (set_id, ord, quest_id, signature, entities, passed), as streaming.state has them.

    Counts are running sums within a set and a signature, component or entity, so no window holds a whole set but for the ids."""
    return with_uses(keep(registered_first(judged), "registered"))


def _before(uses: DataFrame, earlier: DataFrame | None, order: str) -> DataFrame:
    """uses (set_id, (order), registered, kind, x) with uses: how many registered rows before have the same; 0 where its own row repeats it.

    Rows are sorted by a number of what they are first, so that texts are compared within one only."""
    key = ("slot", "set_id", "kind", "x")
    slot = F.xxhash64("set_id", "kind", "x")
    same = Window.partitionBy(*key).orderBy(order)
    n = F.coalesce(F.sum(F.col("registered").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = uses.withColumn("slot", slot).withColumns({"uses": n, "again": F.coalesce(F.lag(order).over(same) == F.col(order), F.lit(False))})
    if earlier is not None:
        sums = earlier.withColumn("slot", slot).groupBy(*key).agg(F.sum("n").alias("past"))
        counted = counted.join(sums, [*key], "left").withColumn("uses", F.col("uses") + F.coalesce("past", F.lit(0)))
    return counted.withColumn("uses", F.when(F.col("again"), 0).otherwise(F.col("uses"))).drop("slot", "again")


def with_uses(rows: DataFrame, earlier: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Rows of registered_first (read more than once) with the uses before them: those by rows before it, and earlier ones (set_id, kind, x, n).

    Repeats are told by their neighbours in the window, so components and entities are dealt twice only: by what they are, and back by row."""
    of_row = _before(used(rows, order), earlier, order).where("uses > 0").repartition(order, "set_id").groupBy(order, "set_id")
    told = KINDS[1:]
    sums = of_row.agg(*[F.sum(F.when(F.col("kind") == k, F.col("uses")).otherwise(0)).alias(name) for k, name in enumerate(told, 1)])
    own = _before(signed(rows, order), earlier, order).withColumnRenamed("uses", KINDS[0])
    return own.join(sums, [order, "set_id"], "left").select("set_id", "ord", "quest_id", "signature", "registered", "signature_uses", *[F.coalesce(k, F.lit(0)).alias(k) for k in told])


def first_wins(rows: DataFrame, id_: str, *order: str) -> DataFrame:
    """rows without those whose id came before, in the order given; rows whose id is blank or null all stay."""
    name = F.trim(F.coalesce(F.col(id_).cast("string"), F.lit("")))
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    blank = rows.where(name == "")
    return rows.where(name != "").withColumn("_nth", nth).where("_nth = 1").drop("_nth").unionByName(blank)


def already_used(sigs: DataFrame) -> DataFrame:
    """Whether an earlier artifact has the signature."""
    w = Window.partitionBy("signature").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sigs.select("quest_id", (F.count("*").over(w) > 0).alias("used_before"))


def least_used(v: Views) -> DataFrame:
    """The least used entity of each type, ties by id."""
    u = v.entity.join(usage(v), "entity_id", "left").select("entity_type", "entity_id", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))
    return u.groupBy("entity_type").agg(F.min(F.struct("uses", "entity_id")).alias("s")).select("entity_type", "s.entity_id", "s.uses")
