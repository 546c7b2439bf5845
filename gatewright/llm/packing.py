"""An exchange of packed arrays: (64-bit token, document, numbers) entries go to the task that owns the token's range,
as a few binary rows for each task that sends and each that receives, instead of a row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix

ENTRIES_PER_PART, CHUNK_ENTRIES = 200_000, 200_000


def parts_for(spark: SparkSession, entries: int) -> int:
    """As many parts as keep their entries to what a task can sort in memory, and as all cores have twice."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-entries // ENTRIES_PER_PART))


def part_keys(spark: SparkSession, parts: int) -> list[int]:
    """A key for each partition that hash partitioning sends just there."""
    ids = spark.range(0, 24 * parts + 200).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    found = {r["p"]: r["id"] for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect()}
    spare = 24 * parts + 200
    return [found.get(i, spare + i) for i in range(parts)]


class Packer:
    """Collects entries of documents and yields packed batches. per_doc: names and types of a document's numbers."""

    def __init__(self, keys: list[int], per_entry: dict[str, str], per_doc: dict[str, str]) -> None:
        self.keys, self.per_entry, self.per_doc = np.array(keys, np.int64), per_entry, per_doc
        self.schema = pa.schema([("part", pa.int32()), ("token", pa.binary()), ("doc", pa.binary()), *((k, pa.binary()) for k in per_entry), *((k, pa.binary()) for k in per_doc)])
        self.clear()

    def clear(self) -> None:
        self.n, self.tokens, self.counts, self.shares = 0, [], [], []
        self.entry = {k: [] for k in self.per_entry}
        self.docs = {k: [] for k in self.per_doc}

    def add(self, tokens: np.ndarray, entry: dict[str, np.ndarray], doc: dict[str, int], split: np.ndarray | None = None) -> None:
        """split: over how many tasks the entries of a token are dealt, by the document."""
        self.tokens.append(tokens)
        self.shares.append(np.zeros(len(tokens), np.uint64) if split is None else (xxhash.xxh32_intdigest(str(doc["id"])) % split).astype(np.uint64))
        self.counts.append(len(tokens))
        for k in self.per_entry:
            self.entry[k].append(entry[k])
        for k in self.per_doc:
            self.docs[k].append(doc[k])
        self.n += len(tokens)

    def full(self) -> bool:
        return self.n >= CHUNK_ENTRIES

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        tokens = np.concatenate(self.tokens)
        doc = np.repeat(np.arange(len(self.counts), dtype=np.uint32), self.counts)
        part = ((tokens >> np.uint64(32)) * np.uint64(len(self.keys)) >> np.uint64(32)).astype(np.int64)
        share = np.concatenate(self.shares)
        if share.any():
            with np.errstate(over="ignore"):
                part = np.where(share > 0, (mix(tokens + share) % np.uint64(len(self.keys))).astype(np.int64), part)
        order = np.argsort(part, kind="stable")
        tokens, doc, part = tokens[order], doc[order], part[order]
        entry = {k: np.concatenate(v).astype(t)[order] for (k, t), v in zip(self.per_entry.items(), self.entry.values())}
        docs = {k: np.array(v, t) for (k, t), v in zip(self.per_doc.items(), self.docs.values())}
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])):
            of, at = np.unique(doc[lo:hi], return_inverse=True)
            cols = [tokens[lo:hi], at.astype(np.uint32), *(v[lo:hi] for v in entry.values()), *(v[of] for v in docs.values())]
            yield pa.RecordBatch.from_arrays([pa.array([int(self.keys[part[lo]])], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], schema=self.schema)
        self.clear()


def deal(packed: DataFrame, parts: int) -> DataFrame:
    return packed.repartition(parts, "part")


def unpack(batches, per_entry: dict[str, str], per_doc: dict[str, str]) -> dict[str, np.ndarray] | None:
    """All entries of a part, sorted by token: arrays token, and the names given (documents' numbers repeated)."""
    got: dict[str, list[np.ndarray]] = {k: [] for k in ("token", *per_entry, *per_doc)}
    for batch in batches:
        for r in batch.to_pylist():
            at = np.frombuffer(r["doc"], np.uint32)
            got["token"].append(np.frombuffer(r["token"], np.uint64))
            for k, t in per_entry.items():
                got[k].append(np.frombuffer(r[k], t))
            for k, t in per_doc.items():
                got[k].append(np.frombuffer(r[k], t)[at])
    if not got["token"]:
        return None
    out = {k: np.concatenate(v) for k, v in got.items()}
    order = np.argsort(out["token"], kind="stable")
    return {k: v[order] for k, v in out.items()}


def pack_fields(per_entry: dict[str, str], per_doc: dict[str, str]) -> str:
    return ", ".join(["part int", "token binary", "doc binary", *(f"{k} binary" for k in (*per_entry, *per_doc))])


def runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values of a sorted array."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1]) if len(tokens) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(tokens)]]))


def in_pieces(rows: int, most: int, make: Callable[[slice], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, rows, most):
        yield make(slice(lo, min(rows, lo + most)))
