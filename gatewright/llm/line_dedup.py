"""Line deduplication: 128-bit hashes of lines in ranges, each range read in the order of hash, document and position.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of MIN_CHARS code points or more that
MIN_DOCS documents or more hold lose their lines except in the largest doc_id that holds them. Ranges are cut over
(hash, document, position, row), so a line that a third of all rows hold is cut over many ranges like all others. Each
range is streamed once: the first document of a hash keeps its lines, the second's lines wait for a third document,
all others' go. What a range cannot know alone, that is what concerns its first and its last hash, is left open:
it names the first documents of these two hashes (three rows each at most), and a broadcast of these few rows decides.
No text leaves its row; what comes out is a compressed bitmap of kept lines for each text that loses some.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id are one document where documents are
counted and where the largest stays, and each is returned with its own lines; rows without doc_id are one document,
the smallest; equal rows get equal results; texts are of any length, a line too; other columns are ignored; an
empty table gives no rows. Lines whose keys have equal 128-bit hashes are taken for equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored, whole

MIN_CHARS, MIN_DOCS, LINES_PER_RANGE = 20, 3, 1_000_000
#: White space that is stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"
LINE = pa.schema([(c, pa.int64()) for c in ("high", "low", "doc_id", "pos", "row", "text_hash", "n_lines")])
MARK = pa.schema([(c, pa.int64()) for c in ("high", "low", "doc_id", "pos", "text_hash", "n_lines")] + [("state", pa.int8())])
GONE, OPEN, HOLDER = 0, 1, 2


def key_of(line: bytes) -> bytes | None:
    """The key, if it is long enough (bytes.lower changes A-Z only)."""
    key = line.strip(SPACE).lower()
    return key if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "replace")) >= MIN_CHARS) else None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that has a key."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in LINE.names}
        for doc, row, text_hash, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "text_hash")), batch["text"]):
            lines = raw.as_py().split(b"\n")
            for pos, line in enumerate(lines):
                key = key_of(line)
                if key is not None:
                    digest = xxhash.xxh3_128_digest(key)
                    values = (int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True), doc, pos, row, text_hash, len(lines))
                    for column, value in zip(out.values(), values):
                        column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=LINE)


class Range:
    """One range's rows, batch by batch in order; yields marks: lines that go, open ones, and the holders of both end hashes."""

    def __init__(self) -> None:
        self.key = None  # of the hash that is being read, as its high and low half
        self.first, self.docs, self.last, self.held = True, 0, None, []

    def read(self, rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        n = len(rows["high"])
        new_key, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = (np.diff(rows["high"]) != 0) | (np.diff(rows["low"]) != 0)
        new_doc[1:] = new_key[1:] | (rows["doc_id"][1:] != rows["doc_id"][:-1]) | (rows["null"][1:] != rows["null"][:-1])
        new_key[0] = (rows["high"][0], rows["low"][0]) != self.key
        new_doc[0] = new_key[0] or (rows["doc_id"][0], rows["null"][0]) != self.last
        at = np.cumsum(new_key)  # 0: the hash of the batch before goes on
        nth = np.cumsum(new_doc)
        starts = np.flatnonzero(new_key)
        before = np.concatenate([[1 - self.docs], nth[starts]])
        nth = nth - before[at]  # place of the row's document among its hash's documents in this range
        ends = np.concatenate([starts - 1, [n - 1]])
        most = np.where(ends >= 0, nth[ends], self.docs - 1)
        enough = most >= MIN_DOCS - 1
        ended = np.arange(len(most)) < len(most) - 1
        is_first = np.zeros(len(most), bool)
        if self.first:
            is_first[0 if self.key is not None else 1] = True
        pick = lambda mask: {c: v[mask] for c, v in rows.items()}
        if self.held and (enough[0] or ended[0]):
            if enough[0] or is_first[0]:
                yield from (self.marked(h, GONE if enough[0] else OPEN) for h in self.held)
            self.held = []
        yield self.marked(pick((nth >= 1) & enough[at]), GONE)
        yield self.marked(pick(is_first[at] & (nth == 0)), OPEN)
        yield self.marked(pick((is_first & ended & ~enough)[at] & (nth >= 1)), OPEN)
        yield self.marked(pick(is_first[at] & new_doc & (nth < MIN_DOCS)), HOLDER)
        rest = pick((~ended & ~enough)[at] & (nth >= 1))
        if len(rest["high"]):
            self.held.append(rest)
        tail = pick((~ended)[at] & new_doc & (nth < MIN_DOCS))
        self.tail = [tail] if new_key.any() else [*self.tail, tail]
        if len(starts):
            self.first = self.first and bool(is_first[-1])
        self.key, self.docs, self.last = (rows["high"][-1], rows["low"][-1]), int(most[-1]) + 1, (rows["doc_id"][-1], rows["null"][-1])

    def close(self) -> Iterator[dict[str, np.ndarray]]:
        if self.key is not None:
            yield from (self.marked(h, OPEN) for h in self.held)
            if not self.first:
                yield from (self.marked(t, HOLDER) for t in self.tail)

    def marked(self, rows: dict[str, np.ndarray], state: int) -> dict[str, np.ndarray]:
        return rows | {"state": np.full(len(rows["high"]), state, np.int8)}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(marks: dict[str, np.ndarray]) -> pa.RecordBatch:
        ids = pa.array(marks["doc_id"], pa.int64(), mask=marks["null"])
        return pa.RecordBatch.from_arrays([ids if f.name == "doc_id" else pa.array(marks[f.name], f.type) for f in MARK], schema=MARK)

    state = Range()
    for batch in batches:
        if batch.num_rows:
            rows = {c: batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in MARK.names[:-1]}
            rows["null"] = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            yield from (made(m) for m in state.read(rows) if len(m["high"]))
    yield from (made(m) for m in state.close() if len(m["high"]))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
    for batch in batches:
        bits = []
        for n, dropped in zip(batch["n_lines"].to_pylist(), batch["dropped"]):
            keep = np.ones(n, bool)
            keep[dropped.values.to_numpy(zero_copy_only=False)] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        counts = pa.array([len(x) for x in batch["dropped"]], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["n_lines"], counts, pa.array(bits, pa.binary())], schema=schema)


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_bitmaps(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep for each text of docs (doc_id, text) that loses lines.

    keep is a zlib-compressed bitmap, most significant bit first, of n_lines bits: 1 where the line stays."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_hash().alias("text_hash"), whole().alias("text"))
    lines = stored(source.mapInArrow(_lines, ", ".join(f"{c} long" for c in LINE.names)), "lines")
    order = [F.col("high"), F.col("low"), F.col("doc_id").desc_nulls_last(), F.col("pos"), F.col("row")]
    parts = ranges or max(2 * spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_RANGE))
    ordered = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marks = stored(ordered.mapInArrow(_stream, ", ".join(f"{c} long" for c in MARK.names[:-1]) + ", state tinyint"), "marks")
    drop(lines)
    # Each range names two hashes at most, and three documents of each: a few rows for each range.
    holders = marks.where(F.col("state") == HOLDER).groupBy("high", "low").agg(F.size(F.collect_set(F.struct("doc_id"))).alias("docs"), F.max("doc_id").alias("largest"))
    decided = marks.where(F.col("state") == OPEN).join(F.broadcast(holders.where(F.col("docs") >= MIN_DOCS)), ["high", "low"]).where("not doc_id <=> largest")
    columns = ["doc_id", "text_hash", "n_lines", "pos"]
    gone = marks.where(F.col("state") == GONE).select(columns).unionByName(decided.select(columns))
    each = gone.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_set("pos").alias("dropped"))
    return each.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> list[bytes]:
    lines = text.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [x for x, bit in zip(lines, bits.tolist()) if bit]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (UTF-8 bytes), keep for each row of docs; keep is null where all lines stay."""
    b = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "keep")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), whole().alias("text"))
    return d.join(b, d["doc_id"].eqNullSafe(b["_doc"]) & (d["text_hash"] == b["_hash"]), "left").select("doc_id", "text", "keep")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text for each row of docs: the lines that stay, joined by line feeds."""
    def run(batches):
        for batch in batches:
            texts = [b"\n".join(kept_lines(t, k)).decode("utf-8", "replace") for t, k in zip(batch["text"].to_pylist(), batch["keep"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return with_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(run, "doc_id long, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for text, keep in zip(batch["text"], batch["keep"].to_pylist()):
            raw = text.as_py()
            n, kept = raw.count(b"\n") + 1, kept_lines(raw, keep)
            rows.append((n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)


def line_dedup(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: a row for each row of docs (doc_id, text)."""
    return with_bitmaps(docs, keep_bitmaps(docs, ranges)).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
