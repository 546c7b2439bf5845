"""Language identification by compression with a zstandard raw-content dictionary for each language.

A dictionary is made of training texts of one language, without lines that several sampled texts share (they tell of
a licence or a page, not of a language). Of dictionaries and texts, lower-cased letters count; what stands between is
blank. A text is compressed, in pieces, with each dictionary; the
language whose dictionary gives the fewest bytes is predicted. score is the softmax of the sizes' differences in a
piece of typical size; a prediction is rejected if the best size is less than min_margin (a share of the second best)
below the second best, if the text is null, or if it has no letter.

Only the dictionaries are fitted on a sample: at most SAMPLE_ROWS labelled rows a language, of which DICT_BYTES are
kept; of a long text, a passage at a place that a hash chooses. Rows are taken by a hash of doc_id and text, so any labelled row may be taken, and the same
rows on each run; however many rows share an id (or have none), the sample keeps its size. Prediction reads whole texts.

Defined results: text null or without a letter: und, score 0, rejected; no labelled training rows (or an empty table):
und for every row; one learned language: that one, score 1, not rejected; equal sizes: the language first in code-point
order, rejected unless min_margin is 0. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

SAMPLE_ROWS, DICT_BYTES, LEVEL = 400, 64_000, 6
PIECE, MIN_MARGIN, MAX_LANGS = 8192, 0.002, 200
#: ASCII that is no lower-case letter becomes a space.
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> bytes:
    return text.lower().encode().translate(TABLE)


def learn(train: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from (doc_id, text, lang) rows.

    A language's rows are sampled by a hash of id and text, of about sample_rows of them and never more (the least hashes), and each sampled
    text gives at most 4 * dict_bytes / sample_rows characters: as many as a dictionary has room for, from a place that
    the hash chooses. Equal rows have one hash and count once."""
    rows = train.where("lang is not null and text is not null and text != ''").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the dictionaries would outgrow a broadcast")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * sample_rows / n))])
    cut = max(64, 4 * dict_bytes // sample_rows)
    start = 1 + F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - cut + 1))
    few = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "h", F.substring("text", start.cast("int"), F.lit(cut)).alias("t"))
    least = few.groupBy("lang").agg(F.array_sort(F.collect_set(F.struct("h", "t"))).alias("xs")).select("lang", F.slice("xs", 1, sample_rows).alias("xs"))
    got = {r["lang"]: [x["t"] for x in r["xs"]] for r in least.collect()}
    seen = Counter(line for ts in got.values() for t in ts for line in set(t.split("\n")))
    out = {}
    for lang, ts in got.items():
        texts = ["\n".join(x for x in t.split("\n") if seen[x] == 1) for t in ts]
        out[lang] = b" ".join(map(letters, texts))[-dict_bytes:] or b" ".join(map(letters, ts))[-dict_bytes:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> None:
        self.langs, self.min_margin = sorted(dictionaries), min_margin
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        raw = letters(text)
        sizes = [0] * len(self.coders)
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            for i, c in enumerate(self.coders):
                sizes[i] += len(c.compress(piece))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        margin = 1 - best / sizes[order[1]] if len(order) > 1 else 1.0
        scale = min(1.0, 400 / best)
        score = 1 / sum(2.0 ** (-(s - best) * scale) for s in sizes)
        return self.langs[order[0]], score, margin, len(order) > 1 and margin < self.min_margin


def _predict(dictionaries: dict[str, bytes], min_margin: float):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        c = Classifier(dictionaries, min_margin)
        for batch in batches:
            out = list(zip(*(c.predict(t.as_py()) for t in batch["text"]))) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, f.type) for x, f in zip(out, list(schema)[1:]))], schema=schema)

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected: a row for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(dictionaries, min_margin), OUT)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rows whose prediction is rejected."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        c = Classifier(dictionaries, min_margin)
        return pa.array([not c.predict(t.as_py())[3] for t in texts], pa.bool_())

    return docs.where(kept("text"))


def language_id(docs: DataFrame, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected; learns from rows that are not held out."""
    out = fold("doc_id", held_out_of) == held_out
    dictionaries = learn(docs.where(~out))
    return identify(docs, dictionaries).select("doc_id", out.alias("held_out"), "lang_pred", "score", "margin", "rejected")
