"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of 13 words, and whole items of fewer. Words are the search's symbols; words that
no item has are one symbol more, which no pattern holds. For patterns of at least m words, the shift table gives for
each block of words how far the window of m words may move on without passing an occurrence's end (m - B + 1 for a
block that no pattern's first m words hold). Where it gives 0, the suffix bucket and the prefix hash select patterns, which
are then compared word by word. Texts are cut into lanes that overlap by the pattern length, and the lanes of a batch
move on together.

A pattern set is broadcast only up to MAX_BLOCK_WORDS benchmark words; a larger benchmark is searched in blocks of
items, one pass over the documents each, and the passes' hits are merged by document. Tables of a block of MAX_BLOCK_WORDS
words are 166 MB as they are sent to a task (830 bytes a word, measured).

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; equal
windows of several items count for each of these; rows that repeat an item_id count as one item; items without an id
count as one item, last in items, which has no name in items_sha256, and their words are hit; repeated documents
are each returned (in several passes, rows are merged by their own number, not by doc_id); an empty table of either
kind gives no rows or no hits.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

WINDOW, MAX_BLOCK_WORDS = 13, 200_000
LANE, CHUNK_WORDS = 1024, 400_000
#: Bytes outside words become spaces, A-Z become lower-case; all bytes of other code points belong to words.
TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RESULT = "n_words long, n_hit long, items array<string>"


def item_words(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def in_order(items) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


class Machine:
    """Shift table, suffix buckets and prefix hashes of patterns of at least m words, over symbols 0 (unknown) to top."""

    def __init__(self, patterns: list[tuple[int, ...]], top: int) -> None:
        self.patterns, self.top = patterns, top + 1
        self.m = min(map(len, patterns))
        self.b = min(2, self.m)
        sym = np.array([p[: self.m] for p in patterns], np.int64)
        bits = max(10, int(np.ceil(np.log2(8 * sym.size))))
        self.mask = (1 << bits) - 1
        self.shift = np.full(1 << bits, self.m - self.b + 1, np.int32)
        for j in range(self.m - self.b + 1):  # later blocks allow shorter shifts
            np.minimum.at(self.shift, self.slot(self.block(sym, j)), self.m - self.b - j)
        key = self.key(self.block(sym, self.m - self.b), self.block(sym, 0))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.lengths = np.array(list(map(len, patterns)), np.int64)
        self.table = np.full((len(patterns), int(self.lengths.max())), -1, np.int64)
        for i, p in enumerate(patterns):
            self.table[i, : len(p)] = p

    def block(self, sym: np.ndarray, j: int) -> np.ndarray:
        out = sym[..., j]
        return out * self.top + sym[..., j + 1] if self.b == 2 else out

    def key(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (suffix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (prefix.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def slot(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences in text (symbols; -1 between documents)."""
        n, m = len(text), self.m
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = text[:-1] * self.top + text[1:] if self.b == 2 else text
        at = np.arange(0, n - m + 1, LANE)
        stop = np.minimum(at + LANE, n - m + 1)
        hits = []
        while len(at):
            move = self.shift[self.slot(blocks[at + m - self.b])]
            hits.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        at = np.concatenate(hits)
        key = self.key(blocks[at + m - self.b], blocks[at])
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        size = hi - lo
        start = np.repeat(at, size)
        which = self.order[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        ok = start + self.lengths[which] <= n
        start, which = start[ok], which[ok]
        for j in range(self.table.shape[1]):  # direct comparison
            want = self.table[which, j]
            same = (want < 0) | (text[np.minimum(start + j, n - 1)] == want)
            start, which = start[same], which[same]
        return start, which


class Patterns:
    """The windows of a block of items, in machines of one kind each: full windows, and shorter items by length class."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, raw in items:
            w = item_words(raw)
            sym = [self.ids.setdefault(x, len(self.ids) + 1) for x in w]
            for i in range(max(0, len(sym) - window) + 1 if sym else 0):
                owners[tuple(sym[i : i + window])].add(item)
        kinds: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for p in owners:
            kinds[1 if len(p) == 1 else 2 if len(p) < 5 else 3 if len(p) < window else 4].append(p)
        self.machines = [Machine(ps, len(self.ids)) for _, ps in sorted(kinds.items())]
        self.owners = [[in_order(owners[p]) for p in m.patterns] for m in self.machines]

    def hits(self, docs: list[list[bytes]]):
        """For each document (its words): number of words hit, items that occur."""
        get = self.ids.get
        sizes = np.array([len(w) + 1 for w in docs], np.int64)
        ends = np.cumsum(sizes)
        text = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
        for w, e in zip(docs, ends):
            text[e - 1 - len(w) : e - 1] = [get(x, 0) for x in w]
        mark, items = np.zeros(len(text) + 1, np.int64), defaultdict(set)
        for machine, owners in zip(self.machines, self.owners):
            start, which = machine.search(text)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + machine.lengths[which], -1)
            for d, p in set(zip(np.searchsorted(ends, start, "right").tolist(), which.tolist())):
                items[d].update(owners[p])
        return np.cumsum(mark)[:-1] > 0, ends, items


def _scan(patterns: Patterns, spans: bool):
    """Rows (row, doc_id) with n_words, n_hit and items; with spans also the hit words' runs, for merging passes."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    schema = pa.schema(fields + [("runs", pa.list_(pa.list_(pa.int64())))] * spans)

    def chunk(rows, docs, ids):
        hit, ends, items = patterns.hits(docs)
        sums = np.concatenate([[0], np.cumsum(hit)])
        starts = ends - [len(w) + 1 for w in docs]
        cols = [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array([len(w) for w in docs], pa.int64()), pa.array(sums[ends - 1] - sums[starts], pa.int64()), pa.array([in_order(items.get(i, ())) for i in range(len(docs))], pa.list_(pa.string()))]
        if spans:
            runs = []
            for s, e in zip(starts, ends - 1):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[s:e].astype(np.int8), [0]])))
                runs.append(edge.reshape(-1, 2).tolist())
            cols.append(pa.array(runs, pa.list_(pa.list_(pa.int64()))))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches):
        for batch in batches:
            rows, docs, ids, n = [], [], [], 0
            for row, doc, raw in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                w = item_words(raw.as_py())
                rows.append(row)
                docs.append(w)
                ids.append(doc)
                n += len(w) + 1
                if n >= CHUNK_WORDS:
                    yield chunk(rows, docs, ids)
                    rows, docs, ids, n = [], [], [], 0
            if docs:
                yield chunk(rows, docs, ids)

    return run


def _blocks(benchmark: DataFrame, most: int):
    """The benchmark's items in blocks of at most most words (an item of more is a block of its own)."""
    block, n = [], 0
    for item, raw in benchmark.select(F.col("item_id").cast("string"), whole()).toLocalIterator():
        k = len(item_words(raw))
        if block and n + k > most:
            yield block
            block, n = [], 0
        block.append((item, bytes(raw)))
        n += k
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """row, doc_id, n_words, n_hit, items (ids as strings, sorted) for each row of docs (doc_id, text)."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    blocks = _blocks(benchmark, max_block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return source.mapInArrow(_scan(Patterns(first, window), False), f"row long, doc_id long, {RESULT}")
    source = stored(source, "numbered")
    passes = None
    for block in (b for bs in ([first, second], blocks) for b in bs):
        hits = stored(source.mapInArrow(_scan(Patterns(block, window), True), f"row long, doc_id long, {RESULT}, runs array<array<long>>"), "pass")
        passes = hits if passes is None else passes.unionByName(hits)
    merged = passes.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    covered = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")), lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r[1] - F.greatest(r[0], a["e"]))).alias("n"), F.greatest(a["e"], r[1]).alias("e")))["n"]
    return merged.select("row", "doc_id", "n_words", covered.alias("n_hit"), "items")


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    found = find_contamination(docs, benchmark, window, max_block_words)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
