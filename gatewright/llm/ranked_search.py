"""Ranked lexical search: for each query item the documents of the greatest scores, by branch and bound over max trees.

Documents stand in ranges of at most FANOUT^DEPTH rows. Over a range each term has a tree: a leaf is a document's impact
(what one unit of the term's weight adds to its score), an inner node the greatest impact below it. The weighted sum of
an item's terms at a node bounds the scores below. A search takes nodes best first, opens those whose bound reaches
the least score that still counts (equal bounds too, for a tie may have a smaller doc_id) and stops where no bound does.

Three passes read the index (documents' counts of query terms, written once): the first bounds all ranges by their roots, the second
searches the BEST_RANGES ranges of the greatest bounds of each item, whose k-th score is a floor for all others, the third
searches all ranges from these floors. So tasks return few documents besides the results, and no list is gathered whole.

Items are a stated query set, taken in blocks of MAX_BLOCK_WORDS words (a longer item is a block of its own); terms and
weights of a block travel with the tasks, and so do its floors. A block is one pass over the documents.

Defined results: a null text or one without terms is no document (N, L and df do not count it) and is never returned;
such an item returns nothing; each row of documents is a document, so rows that repeat a doc_id are ranked each, in any
order between equal scores; a null doc_id comes first among equal scores; rows that repeat an item_id are ranked
each; texts are of any length, and read whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, stored, whole
from .decontamination import item_words

TOP, FANOUT, MAX_BLOCK_WORDS, BEST_RANGES = 20, 16, 50_000, 2
#: Terms up to which a range has FANOUT^3 documents; its leaves are at most as many cells as this times FANOUT^3.
MANY_TERMS = 4096
HIT = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


class Block:
    """A block of items: the terms' numbers, and for each item its terms and how often it repeats each."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for item, raw in items:
            counts = Counter(self.ids.setdefault(w, len(self.ids)) for w in item_words(raw))
            if counts:
                self.items[item] = (np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64))
        self.depth = 3 if len(self.ids) <= MANY_TERMS else 2
        self.span = FANOUT**self.depth

    def weigh(self, documents: int, terms: int, frequency: dict[int, int]) -> None:
        """Weights of what occurs; documents: N; terms: L; frequency: df by term."""
        self.documents, self.terms = documents, terms
        weight = np.zeros(len(self.ids), np.int64)
        for term, df in frequency.items():
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        self.queries = {item: (rows[weight[rows] > 0], (times * weight[rows])[weight[rows] > 0]) for item, (rows, times) in self.items.items()}

    def impact(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        length = 100 - 25 + (25 * n * self.documents) // self.terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * length)


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items (item_id, text) in blocks of at most most words."""
    block, n = [], 0
    for item_id, raw in benchmark.select("item_id", whole()).toLocalIterator():
        k = len(item_words(raw))
        if block and n + k > most:
            yield block
            block, n = [], 0
        block.append((item_id, bytes(raw)))
        n += k
    if block:
        yield block


def _count_terms(ids: dict[bytes, int], span: int):
    """A row for each document with terms: its range, number of terms, and the block's terms with their counts."""
    schema = pa.schema([("range", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        first, place = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = item_words(raw.as_py())
                if words:
                    counts = Counter(words)
                    known = sorted((ids[w], counts[w]) for w in ids.keys() & counts.keys())
                    rows.append((first + place // span, doc, len(words), [t for t, _ in known], [c for _, c in known]))
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run


class Ranges:
    """The documents of one range after another: their ids and lengths, and (document, term, count) of each posting."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self):
        number, docs, parts = None, [], []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            ranges, sizes = batch["range"].to_numpy(), batch["n"].to_numpy()
            ids = batch["doc_id"].to_pylist()
            ends = np.concatenate([[0], np.cumsum([len(t) for t in batch["terms"]])])
            terms, counts = batch["terms"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if number != ranges[lo] and docs:
                    yield number, docs, *map(np.concatenate, zip(*parts))
                    docs, parts = [], []
                number, own = ranges[lo], slice(ends[lo], ends[hi])
                place = len(docs) + np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                parts.append((place, sizes[lo + place - len(docs)], terms[own].astype(np.int64), counts[own].astype(np.int64)))
                docs += ids[lo:hi]
        if docs:
            yield number, docs, *map(np.concatenate, zip(*parts))


class MaxTrees:
    """Levels of the terms' trees, root first: an array of terms by nodes each."""

    def __init__(self, block: Block, place: np.ndarray, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        leaves = np.zeros((len(block.ids), block.span), np.int32)
        leaves[term, place] = block.impact(n, tf)
        self.levels = [leaves]
        while self.levels[0].shape[1] > 1:
            self.levels.insert(0, self.levels[0].reshape(len(leaves), -1, FANOUT).max(axis=2))

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """(score, place) of the k best documents of floor or more and of all that tie with the last; nodes opened."""
        root = int(weights @ self.levels[0][rows, 0])
        heap, found, opened = [(-root, 0, 0)], [], 0
        least = max(floor, 1)
        while heap and -heap[0][0] >= least:
            bound, level, node = heapq.heappop(heap)
            if level == len(self.levels) - 1:
                found.append((-bound, node))
                if len(found) == k:
                    least = max(least, -bound)
                continue
            opened += 1
            bounds = weights @ self.levels[level + 1][:, node * FANOUT : (node + 1) * FANOUT][rows]
            for i in np.flatnonzero(bounds >= least).tolist():
                heapq.heappush(heap, (-int(bounds[i]), level + 1, node * FANOUT + i))
        return found, opened


def _bounds(block: Block):
    """For each item the range of the greatest bound among a task's ranges."""
    schema = pa.schema([("item", pa.int32()), ("range", pa.int64()), ("bound", pa.int64())])

    def run(batches):
        best: dict[int, list[tuple[int, int]]] = {}
        for number, _, _, n, term, tf in Ranges(batches):
            root = np.zeros(len(block.ids), np.int64)
            np.maximum.at(root, term, block.impact(n, tf))
            for item, (rows, weights) in block.queries.items():
                bound = int(weights @ root[rows])
                if bound:
                    best[item] = heapq.nlargest(BEST_RANGES, [*best.get(item, ()), (bound, int(number))])
        rows = [(item, number, bound) for item, ranges in best.items() for bound, number in ranges]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return run


def _by_rank(hit: tuple[int, int | None]) -> tuple[int, bool, int]:
    score, doc = hit
    return -score, doc is not None, doc or 0


def _search(block: Block, floors: dict[int, int], k: int, only: dict[int, set[int]] | None = None):
    """A task's k best documents of each item that reach the item's floor. only: items to search by range (None: all)."""

    def run(batches):
        best: dict[int, list[tuple[int, int | None]]] = {}
        for number, docs, place, n, term, tf in Ranges(batches):
            trees = MaxTrees(block, place, n, term, tf)
            for item in block.queries if only is None else only[int(number)]:
                own = best.setdefault(item, [])
                floor = max(floors.get(item, 0), own[-1][0] if len(own) == k else 0)
                found, _ = trees.best(*block.queries[item], k, floor)
                if found:
                    best[item] = sorted([*own, *((score, docs[p]) for score, p in found)], key=_by_rank)[:k]
        rows = [(item, doc, score) for item, hits in best.items() for score, doc in hits]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, HIT)], schema=HIT)

    return run


def _top(hits: DataFrame, by: str, *order, most: int) -> DataFrame:
    """The first rows of each by; Spark cuts them before they are shuffled, too."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item, rank, doc_id, score of one block over docs (doc_id, text as bytes)."""
    fields = "range long, doc_id long, n long, terms array<int>, counts array<int>"
    index = stored(docs.mapInArrow(_count_terms(block.ids, block.span), fields), "search")
    total = index.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # as many rows as the block has terms at most
    block.weigh(total.documents, total.terms or 1, {r["term"]: r["count"] for r in df})
    bounds = index.select(index.columns).mapInArrow(_bounds(block), "item int, range long, bound long")
    only: dict[int, set[int]] = {}
    for r in _top(bounds, "item", F.desc("bound"), "range", most=BEST_RANGES).collect():  # a few rows for each item of the block
        only.setdefault(r["range"], set()).add(r["item"])
    floors = {}
    if only:
        chosen = index.where(F.col("range").isin(list(only)))
        first = _top(chosen.mapInArrow(_search(block, {}, k, only), "item int, doc_id long, score long"), "item", F.desc("score"), "doc_id", most=k)
        floors = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).collect()}
    hits = index.mapInArrow(_search(block, floors, k), "item int, doc_id long, score long")
    ranked = stored(_top(hits, "item", F.desc("score"), F.asc_nulls_first("doc_id"), most=k), "hits", rows=k * len(block.items))
    drop(index)
    return ranked


def ranked_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs (doc_id, text) for each row of benchmark (item_id, text)."""
    spark = docs.sparkSession
    item_id = benchmark.select("item_id").schema["item_id"].dataType.simpleString()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    out = spark.createDataFrame([], f"item_id {item_id}, rank int, doc_id long, score long")
    for items in blocks(benchmark, max_block_words):
        ranked = search_block(source, Block([(i, raw) for i, (_, raw) in enumerate(items)]), k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {item_id}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a block's items only
    return out
