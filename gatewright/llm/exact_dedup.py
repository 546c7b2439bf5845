"""Exact deduplication over an extendible-hash index kept on shared files.

A text's key is a 64-bit hash of its normalised form. The directory has 2^depth slots, indexed by a key's leading
bits; a bucket that holds more than its capacity of keys is split on one more bit, and the directory doubles whenever
that bucket's own depth has reached the directory's. Scanning tasks first combine equal texts of a batch (so that a
text with very many copies reaches its owner once a batch, not once a copy), write these entries to the shared
folder, and owner tasks each take the buckets of their key ranges, compare bytes within a key and chain the texts
that collide. The index and the entries are joined by entry number; no group is ever gathered in one place.

Defined results: a null text counts as empty; rows with equal texts form one group, and the largest doc_id stays (a
null doc_id is the smallest); rows that repeat a doc_id with its text are each returned, and all carry kept = true if
that id stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

MIN_CAPACITY, MAX_BUCKETS, MAX_DEPTH = 512, 1 << 14, 22


class Directory:
    """Slots of leading key bits that lead to buckets; a bucket is named by its prefix of as many bits as its own depth."""

    def __init__(self) -> None:
        self.depth, self.slots, self.prefix, self.local = 0, np.zeros(1, np.int32), [0], [0]

    def span(self, bucket: int, bits: int) -> tuple[int, int]:
        """The range of bits-long prefixes that a bucket has."""
        width = bits - self.local[bucket]
        return self.prefix[bucket] << width, (self.prefix[bucket] + 1) << width

    def split(self, bucket: int) -> int:
        """Split a bucket on its next bit; the directory doubles if it has no bit left for that. Returns the new bucket."""
        if self.local[bucket] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        new = len(self.local)
        self.local[bucket] += 1
        self.prefix[bucket] *= 2
        self.local.append(self.local[bucket])
        self.prefix.append(self.prefix[bucket] + 1)
        self.slots[slice(*self.span(new, self.depth))] = new
        return new

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        u = keys.astype(np.int64).view(np.uint64)
        return self.slots[(u >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(u), np.int32)


def build_directory(keys: DataFrame, min_capacity: int = MIN_CAPACITY, max_buckets: int = MAX_BUCKETS) -> Directory:
    """Grow the directory until no bucket holds more distinct keys than its capacity, or its bits are used up (then its
    keys are chained further). Only counts by leading bits come to the driver: at most 2^MAX_DEPTH numbers, and those
    beyond 2^14 only below buckets that need them."""
    distinct = stored(keys.select("key").distinct(), "keys")
    capacity = max(min_capacity, distinct.count() // max_buckets)
    d, bits, todo = Directory(), 14, [0]
    while True:
        seen = distinct.select(F.expr(f"shiftrightunsigned(key, {64 - bits})").alias("p"))
        if d.depth:
            seen = seen.where(F.expr(f"shiftright(p, {bits - d.depth})").isin([d.prefix[b] for b in todo]))
        counts = np.zeros(1 << bits, np.int64)
        for r in seen.groupBy("p").count().toLocalIterator():
            counts[r["p"]] = r["count"]
        sums = np.concatenate([[0], np.cumsum(counts)])

        def held(b: int) -> int:
            lo, hi = d.span(b, bits)
            return int(sums[hi] - sums[lo])

        stack, todo = [b for b in todo if held(b) > capacity], []
        while stack:
            b = stack.pop()
            if d.local[b] == bits:
                todo.append(b)
            else:
                stack += [x for x in (b, d.split(b)) if held(x) > capacity]
        if not todo or bits == MAX_DEPTH:
            return d
        bits = MAX_DEPTH


def _combine(directory: Directory):
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            at: dict[bytes, int] = {}
            keys, ids = [], []
            for doc, key, text in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["text"].to_pylist()):
                i = at.setdefault(text, len(ids))
                if i == len(ids):
                    keys.append(key)
                    ids.append([])
                ids[i].append(doc)
            if not ids:
                continue
            tops = [max((x for x in xs if x is not None), default=None) for xs in ids]
            yield pa.RecordBatch.from_arrays([pa.array(directory.bucket(np.array(keys, np.int64)), pa.int32()), pa.array(keys, pa.int64()), pa.array(list(at), pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(tops, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=schema)

    return run


def _own(batches):
    """Entries come ordered by key: texts of a key are chained, compared by their bytes."""
    schema = pa.schema([("uid", pa.int64()), ("key", pa.int64()), ("link", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
    cur, chain, out = None, [], []

    def flush():
        out.extend((None, cur, i, top, n, hashlib.sha256(text).hexdigest()) for i, (text, n, top) in enumerate(chain))
        chain.clear()

    def ready():
        rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return rows

    for batch in batches:
        for uid, key, text, n, top in zip(*(batch[c].to_pylist() for c in ("uid", "key", "text", "n", "top"))):
            if key != cur:
                if chain:
                    flush()
                cur = key
            for i, x in enumerate(chain):
                if x[0] == text:
                    x[1] += n
                    x[2] = top if x[2] is None else x[2] if top is None else max(top, x[2])
                    break
            else:
                i = len(chain)
                chain.append([text, n, top])
            out.append((uid, key, i, None, None, None))
        if out:
            yield ready()
    if chain:
        flush()
        yield ready()


def exact_dedup(docs: DataFrame, min_capacity: int = MIN_CAPACITY, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs (doc_id, text)."""
    norm = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(norm).alias("key"), norm.cast("binary").alias("text"))
    directory = build_directory(keyed, min_capacity, max_buckets)
    entries = keyed.mapInArrow(_combine(directory), "bucket int, key long, text binary, n long, top long, ids array<long>")
    entries = stored(entries.withColumn("uid", F.monotonically_increasing_id()), "entries")
    owned = entries.select("bucket", "key", "uid", "text", "n", "top").repartition("bucket").sortWithinPartitions("bucket", "key")
    index = stored(owned.mapInArrow(_own, "uid long, key long, link int, keep_id long, group_size long, text_sha256 string"), "index")
    groups = index.where("uid is null").drop("uid")
    found = index.where("uid is not null").select("uid", "key", "link").join(groups, ["key", "link"])
    rows = entries.select("uid", "ids").join(found, "uid").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
