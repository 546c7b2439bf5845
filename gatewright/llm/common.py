"""Helpers that the training-data operators share: scratch tables, whole-text columns, tokens."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words stand between space and tab to carriage return; bytes.split() splits on the same ones.
# Python workers are kept for later tasks: with this pool, memory of past batches goes back to the machine.
pa.set_memory_pool(pa.system_memory_pool())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor sees, below spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a folder of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gatewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None, per: int = 50_000) -> DataFrame:
    """Write df to a scratch table and read it back: lineage is cut and the rows survive lost executors.

    rows: about how many there are, where that is known; then no more tasks write than have per rows each, so a small
    table is not dealt over as many files as a large one."""
    spark = df.sparkSession
    path = scratch(spark, name)
    few = df if rows is None else df.coalesce(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))))
    batch = spark.conf.get(BATCH_ROWS)
    try:  # texts are large rows: batches of fewer need less memory on both sides
        spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))
        few.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, batch)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables (as stored returns them) that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit("")).cast("binary")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def words(raw: bytes) -> list[bytes]:
    """Tokens between white space, A-Z lower-cased."""
    return raw.lower().split()


class WordHashes(dict):
    """64-bit hashes of words, kept for reuse up to a bound."""

    LIMIT = 60_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def word_hashes(tokens: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(tokens: list[bytes], cache: WordHashes, width: int = 5) -> np.ndarray:
    """Hashes of the width-word shingles in text order; fewer words make one shingle, none make none."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = word_hashes(tokens, cache)
    if len(h) < width:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(tokens), seed=7)], np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
        return mix(out)
