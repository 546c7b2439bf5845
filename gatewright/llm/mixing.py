"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot k of the schedule takes the point frac((k + 1) / golden ratio), which the sources' cumulative weights map to a
source; the slots of a source are ranked in schedule order. Documents of a source stand in an order shuffled by a hash
of their ids, and their words are cut into blocks of equal size. A source's slot of rank r takes its block r modulo its
number of blocks, so every prefix of the schedule is close to the target weights, and a source is read a second time
only after its last block.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share ratio times all words; a target
stops at cap times its source's words, and the excess is shared again by weight among the others.

Ranks and word positions are running sums in two levels (within runs of slots or hash buckets, and over these), so no
task gathers a source. Only totals by source come to the driver (MAX_SOURCES at most). A block has
min(target) / BLOCKS words, but 1 at least and enough to keep to MAX_SLOTS slots: a source misses its target by a few
blocks at most.

Defined results: a null text has size 0; documents without words take 0; a source without words has target 0; equal
ids are ordered by their text's hash; repeated rows are each returned, and take what their places give; an empty table
gives no rows. Reruns agree: nothing depends on partitions or on chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WEIGHTS, RATIO, CAP = (3, 1, 2), 1.5, 2.0
BLOCKS, MAX_SLOTS, MAX_SOURCES = 1000, 200_000_000, 10_000
MAX_BROADCAST_IDS = 1_000_000
RUN = 4096
GOLDEN = 0.6180339887498949


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than space and tab to carriage return; a null text has none."""
    blank = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    starts = F.regexp_count(blank, F.lit("[^ ]+"))
    return starts.cast("long")


def targets(sizes: list[int], weights: list[float], ratio: float = RATIO, cap: float = CAP) -> list[float]:
    """Shares of ratio times all words by weight; none above cap times its own words while others have room."""
    out, left = [0.0] * len(sizes), ratio * sum(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        for i in over or free:
            out[i] = cap * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _numbers(xs: list, kind: str) -> Column:
    """A constant array; one literal however long."""
    return F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")


def _before(df: DataFrame, group: list[str], run: str, order: list[Column], n: Column, name: str) -> DataFrame:
    """df with the sum of n over earlier rows of its group, in order of run and then order."""
    runs = df.groupBy(*group, run).agg(F.sum(n).alias("in_run"))
    earlier = Window.partitionBy(*group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.select(*group, run, F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("head"))
    within = Window.partitionBy(*group, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn(name, F.coalesce(F.sum(n).over(within), F.lit(0)))
    return inner.join(heads, [*group, run]).withColumn(name, F.col(name) + F.col("head")).drop("head")


def schedule(spark, slots: int, shares: list[float]) -> DataFrame:
    """source number s and rank of each slot: s int, rank long."""
    edges = [sum(shares[: i + 1]) for i in range(len(shares))]
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0))
    bounds = _numbers(edges, "double")
    # The cumulative weights as a small sorted array: the source is the number of edges at or below the point.
    cells = 4096
    steps = [next((i for i, e in enumerate(edges) if e > c / cells), len(edges) - 1) for c in range(cells)]
    first = F.get(_numbers(steps, "int"), F.floor(point * cells).cast("int"))
    s = F.when(point < F.get(bounds, first), first)
    for k in range(1, 4):  # a cell rarely holds more than one edge
        s = s.when(point < F.get(bounds, first + k), first + k)
    s = s.otherwise(F.size(F.filter(bounds, lambda e: e <= point)))
    picks = spark.range(slots).select("id", F.least(s, F.lit(len(edges) - 1)).cast("int").alias("s"), F.floor(F.col("id") / RUN).alias("run"))
    return _before(picks, ["s"], "run", [F.col("id")], F.lit(1).cast("long"), "rank").select("s", "rank")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, and uid (a number of the row): a row for each row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string")).alias("h"), F.xxhash64("text").alias("th"))
    sized = stored(sized.withColumn("uid", F.monotonically_increasing_id()), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy(F.col("source").isNull(), F.col("source").cast("binary")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["n"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], ratio, cap)
    live = [i for i, t in enumerate(goal) if t > 0]
    total = sum(goal)
    block = max(1, int(min((goal[i] for i in live), default=1) // BLOCKS), -int(-total // MAX_SLOTS))
    number = spark.createDataFrame([(r["source"], i, int(r["n"]), float(goal[i]), 1 + r["rows"] // RUN) for i, r in enumerate(totals)], "source string, s int, source_size long, target double, runs long")
    rows = sized.join(F.broadcast(number), sized["source"].eqNullSafe(number["source"])).select("doc_id", "uid", "size", "s", "source_size", "target", "h", "th", F.floor((F.shiftrightunsigned("h", 1) / F.lit(2.0**63)) * F.col("runs")).alias("run"))
    if not live:
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "uid")
    placed = stored(_before(rows, ["s"], "run", [F.col(c) for c in ("h", "doc_id", "th", "uid")], F.col("size"), "at"), "placed")
    ranks = schedule(spark, round(total / block), [goal[i] / total for i in live])
    back = F.get(_numbers(live, "int"), F.col("s"))
    blocks_of = F.get(_numbers([-(-n // block) for n in sizes], "bigint"), F.col("s"))
    slots = ranks.select(back.alias("s"), "rank").where(F.col("rank") < F.lit(int(cap)) * blocks_of).select("s", F.pmod("rank", blocks_of).alias("block"))
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    cut = F.lit(block)
    pieces = placed.where("size > 0").select("uid", "s", F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"), F.explode(F.sequence(F.floor(F.col("at") / cut), F.floor((F.col("at") + F.col("size") - 1) / cut))).alias("block"))
    inside = F.least("hi", (F.col("block") + 1) * cut) - F.greatest("lo", F.col("block") * cut)
    taken = pieces.join(times, ["s", "block"]).groupBy("uid").agg(F.sum(inside * F.col("times")).alias("taken"))
    return placed.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "uid")


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """docs with each row as often as the mix reads any of it: not at all, once, or again in the second reading.

    docs is read three times. Texts are moved only where there are more than MAX_BROADCAST_IDS ids."""
    again = F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))
    copies = stored(mix(docs, weights, ratio, cap).groupBy("doc_id").agg(F.max(again).cast("int").alias("copies")).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies")), "copies")
    few = copies.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = F.col("id").eqNullSafe(F.col("_id"))
    return rows.join(F.broadcast(copies) if few else copies, at).select(F.inline(F.array_repeat("row", F.col("_copies"))))
