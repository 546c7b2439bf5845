"""Phrase collocation mining with pivot partitioning: each phrase is counted where its rarest word is.

Words are counted first. Their counts, at most SLOTS numbers indexed by hash (a slot has the greatest count of its
words), travel with the tasks; they order words by rarity, and a word whose slot stays below MIN_COUNT is rarer than any
phrase may be. For each occurrence of a word (the pivot) the words around it, two on each side, form a fragment, which
ends at pieces' ends, at rare words, at words rarer than the pivot, and to the left also at the pivot itself: so the pivot is the
leftmost of the rarest words of every phrase in the fragment that contains it, and no phrase has two owners. Equal fragments of
a chunk of texts become one with a count. They are packed and sent to the pivot's task, which counts the phrases
that contain the pivot and returns those of MIN_COUNT or more. A pivot of more fragments than a task should have is dealt over
several tasks by its neighbours; these return what they have counted, and their counts are summed.

Order: counts of slots decide which task counts a phrase, never what is counted.

Defined results: a null text is empty; a null lang is und, one with documents whose lang is und; rows that repeat a
doc_id are counted each; texts are of any length, and read whole; ties in rank are settled by count and by phrase
in byte order; counts below 10^15 are exact (38-digit products); other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, mix, stored, whole
from .packing import deal, part_keys

MIN_COUNT, TOP, COVERED_PERCENT = 10, 2000, 50
SLOTS, CHUNK_WORDS, MAX_WORDS, FRAGMENTS_PER_PART = 1 << 21, 1_000_000, 1 << 19, 1_000_000
#: Phrases of a part are packed as three word numbers of 21 bits.
WORD_BITS = 21
SALTS = 64
#: A-Z become lower-case; what ends a piece becomes "!", tabs become spaces.
TABLE = bytes(33 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
PHRASE = "lang string, w1 string, w2 string, w3 string, f long, partial boolean"
FIELDS = "part int, langs array<string>, lang_of binary, words array<binary>, numbers binary, times binary, dealt binary"
MESSAGE = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("lang_of", pa.binary()), ("words", pa.list_(pa.binary())), ("numbers", pa.binary()), ("times", pa.binary()), ("dealt", pa.binary())])


def tokens(raw: bytes) -> list[bytes]:
    """Words of the text, with b"!" between pieces; spaces are the only white space that the table leaves."""
    return raw.translate(TABLE).replace(b"!", b" ! ").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, f: a task's counts, handed on whenever MAX_WORDS words have gathered."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
    counts: dict[str, Counter] = defaultdict(Counter)

    def rows():
        for lang, own in counts.items():
            own.pop(b"!", None)
            words = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], schema=schema)
        counts.clear()

    for batch in batches:
        for lang, raw in zip(batch["lang"].to_pylist(), batch["text"]):
            counts[lang].update(tokens(raw.as_py()))
        if sum(map(len, counts.values())) > MAX_WORDS:
            yield from rows()
    yield from rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words of docs (lang, text as bytes)."""
    return docs.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def slot_counts(words: DataFrame, slots: int) -> np.ndarray:
    """The greatest count of each slot's frequent words; 0 where a slot has none. At most slots numbers come to the driver."""
    slot = F.pmod(F.xxhash64(F.concat_ws("\0", "lang", "word")), F.lit(slots))
    out = np.zeros(slots, np.int32)
    for r in words.groupBy(slot.alias("slot")).agg(F.max("f").alias("f")).select("slot", F.least("f", F.lit(2**31 - 1)).alias("f")).toArrow().to_batches():
        out[r["slot"].to_numpy()] = r["f"].to_numpy()
    return out


def word_hash(lang: str, word: bytes) -> int:
    """As xxhash64 of the words table has it."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed=42)


class Dictionary:
    """Numbers of words, by language; number 0 ends fragments."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.words, self.hashes = counts, [("", b"!")], [0]
        self.by_lang: dict[str, dict[bytes, int]] = {}

    def of(self, lang: str) -> dict[bytes, int]:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Numbers(self, lang)
        return self.by_lang[lang]

    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its place from rarest to most frequent, -1 where it is too rare; its slot's count; its hash."""
        h = np.array(self.hashes, np.uint64)
        count = self.counts[(h.view(np.int64) % len(self.counts))].astype(np.int64)
        count[0] = 0
        by = np.lexsort((h, count))
        same = (np.diff(count[by]) == 0) & (np.diff(h[by]) == 0)
        if same.any():
            by = np.array(sorted(range(len(h)), key=lambda i: (count[i], self.hashes[i], self.words[i])))
        place = np.empty(len(h), np.int64)
        place[by] = np.arange(len(h))
        place[count < MIN_COUNT] = -1
        return place, count, h


class _Numbers(dict):
    def __init__(self, all_words: Dictionary, lang: str) -> None:
        super().__init__({b"!": 0})
        self.all, self.lang = all_words, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.all.words)
        self.all.words.append((self.lang, word))
        self.all.hashes.append(word_hash(self.lang, word))
        return number


def fragments(text: np.ndarray, core: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments of a text of word numbers, five columns (two left, pivot, two right; 0 is none), and their counts.

    core: the words that are pivots here (others are there as their neighbours)."""
    rank = np.concatenate([[-1, -1], place[text], [-1, -1]])
    word = np.concatenate([[0, 0], text, [0, 0]]).astype(np.int64)
    n = len(text)
    own = rank[2 : n + 2]
    left1 = rank[1 : n + 1] > own
    left2 = left1 & (rank[:n] > own)
    right1 = rank[3 : n + 3] >= own
    right2 = right1 & (rank[4 : n + 4] >= own)
    pivot = np.flatnonzero(core & (own >= 0) & (left1 | right1))
    sides = [np.where(ok[pivot], word[pivot + at], 0) for at, ok in ((0, left2), (1, left1), (3, right1), (4, right2))]
    near = triple(word[pivot + 2], sides[1], sides[2])
    far = triple(0, sides[0], sides[3])
    by = np.lexsort((far, near))
    near, far = near[by], far[by]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(near)), bool), (np.diff(near) != 0) | (np.diff(far) != 0)]))
    (own, left1, right1), (_, left2, right2) = parts_of(near[start]), parts_of(far[start])
    return np.stack([left2, left1, own, right1, right2], 1), np.diff(np.concatenate([start, [len(by)]]))


def triple(a, b, c):
    return a << 2 * WORD_BITS | b << WORD_BITS | c


def parts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << WORD_BITS) - 1
    return key >> 2 * WORD_BITS, key >> WORD_BITS & low, key & low


def _send(counts: np.ndarray, keys: list[int], per_part: int, chunk_words: int):
    """Fragments for each part, packed by column: the words they use, their numbers, counts, and whether a pivot is dealt over parts."""
    parts = len(keys)

    def packed(d: Dictionary, text: list[np.ndarray], core: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, count, h = d.order()
        table, times = fragments(np.concatenate(text), np.concatenate(core), place)
        pivot = table[:, 2]
        split = -(-count[pivot] // per_part)
        with np.errstate(over="ignore"):
            share = mix(h[table[:, 1]] * np.uint64(31) + h[table[:, 3]]) % split.astype(np.uint64)
            part = (mix(h[pivot] + share) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        table, times, part, split = table[by], times[by], part[by], split[by]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])):
            if hi > lo:
                used, local = np.unique(table[lo:hi], return_inverse=True)
                words = [d.words[i] for i in used.tolist()]
                langs = list(dict.fromkeys(lang for lang, _ in words))
                at = {lang: i for i, lang in enumerate(langs)}
                row = {
                    "part": keys[part[lo]], "langs": langs, "lang_of": np.array([at[lang] for lang, _ in words], np.uint32).tobytes(), "words": [w for _, w in words],
                    "numbers": zstandard.compress(local.reshape(-1, 5).T.astype(width(len(used))).tobytes(), 1), "times": times[lo:hi].astype(np.uint32).tobytes(), "dealt": np.packbits(split[lo:hi] > 1).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=MESSAGE)

    def run(batches):
        d, text, core, n = Dictionary(counts), [], [], 0
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), batch["text"]):
                words = tokens(raw.as_py())
                for lo in range(0, len(words), chunk_words):  # longer texts come in pieces, with two neighbours on each side
                    piece = words[max(0, lo - 2) : lo + chunk_words + 2]
                    if n + len(piece) > chunk_words and text:  # so MAX_WORDS and a chunk's words are fewer than numbers
                        yield from packed(d, text, core)
                        text, core, n = [], [], 0
                        if len(d.words) > MAX_WORDS:
                            d = Dictionary(counts)
                    at = np.arange(len(piece)) + max(0, lo - 2)
                    text += [np.fromiter(map(d.of(lang).__getitem__, piece), np.int32, len(piece)), np.zeros(1, np.int32)]
                    core += [(at >= lo) & (at < lo + chunk_words), np.zeros(1, bool)]
                    n += len(piece)
        if text:
            yield from packed(d, text, core)

    return run


def width(words: int):
    return np.uint16 if words < 1 << 16 else np.uint32


class Counts:
    """A part's counts of phrases, as numbers of words (0: none) in one integer; partial counts are kept apart from whole ones."""

    def __init__(self) -> None:
        self.flushed = False
        self.clear()

    def clear(self) -> None:
        self.words, self.by_lang, self.pools, self.waiting = [("", b"")], defaultdict(dict), {False: [], True: []}, 0

    def number(self, lang: str, word: bytes) -> int:
        own = self.by_lang[lang]
        if word not in own:
            own[word] = len(self.words)
            self.words.append((lang, word))
        return own[word]

    def add(self, row: dict) -> None:
        langs = [row["langs"][i] for i in np.frombuffer(row["lang_of"], np.uint32).tolist()]
        mine = np.array([self.number(lang, w) if w != b"!" else 0 for lang, w in zip(langs, row["words"])], np.int64)
        left2, left1, own, right1, right2 = mine[np.frombuffer(zstandard.decompress(row["numbers"]), width(len(mine))).reshape(5, -1)]
        times = np.frombuffer(row["times"], np.uint32).astype(np.int64)
        dealt = np.unpackbits(np.frombuffer(row["dealt"], np.uint8), count=len(times)).astype(bool)
        for partial in np.unique(dealt).tolist():
            for ok, a, b, c in ((left1, left1, own, 0), (right1, own, right1, 0), (left2, left2, left1, own), (left1 * right1, left1, own, right1), (right2, own, right1, right2)):
                at = (ok > 0) & (dealt == partial)
                key = triple(a, b, c)[at]
                self.pools[partial].append((key, times[at]))
                self.waiting += len(key)
        if self.waiting > 4 * FRAGMENTS_PER_PART:
            self.pools = {k: [summed(v)] for k, v in self.pools.items()}
            self.waiting = 0

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Whole counts of MIN_COUNT or more, and all partial ones; where words run out of numbers, what has come so far is partial."""
        self.flushed |= not last
        for dealt, pool in self.pools.items():
            partial = dealt or self.flushed
            key, f = summed(pool)
            if not partial:
                key, f = key[f >= MIN_COUNT], f[f >= MIN_COUNT]
            for lo in range(0, len(key), 50_000):
                numbers = [x.tolist() for x in parts_of(key[lo : lo + 50_000])]
                text = [pa.array([self.words[i][1] if i else None for i in x], pa.binary()).cast(pa.string()) for x in numbers]
                langs = pa.array([self.words[i][0] for i in numbers[0]], pa.string())
                yield pa.RecordBatch.from_arrays([langs, *text, pa.array(f[lo : lo + 50_000]), pa.array([partial] * len(langs))], names=["lang", "w1", "w2", "w3", "f", "partial"])
        self.clear()


def summed(pool: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pool:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, f = map(np.concatenate, zip(*pool))
    by = np.argsort(key, kind="stable")
    key, f = key[by], f[by]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), np.diff(key) != 0]))
    return key[start], np.add.reduceat(f, start) if len(start) else f


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in MESSAGE.names[1:]}
            if len(counts.words) + len(row["words"]) >= 1 << WORD_BITS:
                yield from counts.rows(last=False)
            counts.add(row)
    yield from counts.rows(last=True)


def frequent_phrases(docs: DataFrame, words: DataFrame, n_words: int, per_part: int = FRAGMENTS_PER_PART, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, w1, w2, w3 (null: two words), f of all phrases with f of MIN_COUNT or more; words: frequent words."""
    spark = docs.sparkSession
    slots = SLOTS
    while slots > 1024 and slots > 8 * n_words:
        slots //= 2
    counts = slot_counts(words, slots)
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // per_part))
    sent = docs.mapInArrow(_send(counts, part_keys(spark, parts), per_part, chunk_words), FIELDS)
    mined = stored(deal(sent, parts).mapInArrow(_mine, PHRASE), "mined")
    columns = ["lang", "w1", "w2", "w3"]
    dealt = mined.where("partial").groupBy(columns).agg(F.sum("f").alias("f")).where(F.col("f") >= MIN_COUNT)
    return mined.where("not partial").select(*columns, "f").unionByName(dealt)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with a, l, r and score of the lowest-scoring cut, without those that a longer phrase covers."""
    two = phrases.where("w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    three = phrases.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    word = lambda name, f: words.select("lang", F.col("word").alias(name), F.col("f").alias(f))
    inner = [three.select("lang", F.col("w1"), F.col("w2"), "a"), three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")]
    covers = inner[0].unionByName(inner[1]).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    free = two.join(covers, ["lang", "w1", "w2"], "left").where(F.expr(f"longer is null or 100 * longer < {COVERED_PERCENT} * a")).drop("longer")
    pairs = free.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    cut = lambda l, r: F.expr(f"cast(1000000 as decimal(7)) * cast(a as decimal(15)) * cast(a as decimal(15)) div (cast({l} as decimal(19)) * cast({r} as decimal(19)))")
    out = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", cut("l", "r").alias("score"))
    start = two.select("lang", "w1", "w2", F.col("a").alias("l2"))
    end = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    triples = three.join(start, ["lang", "w1", "w2"]).join(end, ["lang", "w2", "w3"]).join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    both = triples.withColumn("s1", cut("l1", "r1")).withColumn("s2", cut("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    three_out = both.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    return out.unionByName(three_out)


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The top first phrases of each lang, with rank: of SALTS lots of a lang each, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lots = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = phrases.withColumn("rank", F.row_number().over(lots)).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, per_part: int = FRAGMENTS_PER_PART, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each lang of docs (lang, text).

    per_part: fragments that a task should have; chunk_words: words whose fragments are made at once."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().alias("text"))
    every = stored(word_counts(source), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.where(F.col("f") >= MIN_COUNT)
    phrases = stored(frequent_phrases(source, words, words.count(), per_part, chunk_words), "phrases")
    best = stored(ranked(scored(phrases, words), top), "collocations")
    out = stored(best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "ranked")
    drop(every, phrases, best)
    return out
