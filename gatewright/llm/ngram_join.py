"""Jaccard self-join of documents' sets of 5-word shingles with adaptive multi-match prefixes.

Shingles have one order for all documents: those that few documents have come first, by their hashes, and those found
frequent come last, by estimated count. With T = ceil(threshold * size), two sets that reach the threshold share at
least l of their first size - T + l shingles, for every l; so a document may choose its l. It takes the l of 1 to
MAX_MATCH whose cost is least: entries to look up, plus pairs to verify, of which there are at most the sum of (count
- 1) over its prefix divided by l. Two documents are verified if they share the smaller of their l's, if sizes and the
first shared place leave room for enough others, if the rare shingles that a document shares with nobody leave room for
them, and if bitmaps of both sets do (each differing parity is an element that only one has). All filters are exact.

No group is expanded into all its pairs where that is idle. Equal sets are one class. Within the list of a shingle,
each document is first held against the list's hub, the document with most in common with others; then components are
formed, and only pairs across components are formed, at their first shared shingle, and verified. What links there are
between documents of different components is found exactly, so components are exact, without any cap on lists or pairs.
Lists of very frequent shingles are split over tasks; each part has a hub, and pairs of different parts are pairs across.

Counts cover all documents: a chunk of documents reports what occurs in it more than once; sums of these estimate
counts, and the MAX_FREQUENT largest are the frequent shingles (a broadcast of 16 bytes each). They steer the order and
the choice of l, never which links exist.

Sets are sets of 64-bit hashes of shingles: two different shingles of one pair of documents are taken for equal with a
chance of 2 ** -64 each. Sets and their digests are the only form in which texts meet; words are not compared again.

Defined results: null or wordless text: n_shingles 0, a component of its own; 1 to 4 words: one shingle of the whole
sequence; null doc_id: counted, links with nothing, component_id null; rows that repeat a doc_id are one document (linked
with whatever any of its rows is linked with) and are each returned; very long texts are one set like any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, drop, shingle_hashes, stored, whole, words
from .components import components
from .packing import Packer, deal, in_pieces, pack_fields, part_keys, parts_for, runs, unpack

WIDTH, NUM, DEN = 5, 75, 100
MAX_MATCH, MAX_FREQUENT, MIN_FREQUENT, VERIFY_COST = 4, 300_000, 4, 16.0
MAX_BROADCAST_IDS, CHUNK, LAST, PAIRS_PER_TASK = 1_000_000, 1_000_000, 65_535, 1_000
STATS = "doc_id long, n long, sig binary, bits binary, token long, count long"
#: Tokens estimated at this count or more are split over several tasks, each with a hub of its own.
SPLIT = 500_000
#: all_rare: whether the prefix holds all shingles of the set that are not frequent; rare: how many of them it holds.
ENTRY, DOC = {"pos": "u2"}, {"id": "i8", "n": "u4", "match": "u1", "weight": "u4", "rare": "u2", "all_rare": "u1"}


def needed(n):
    """The smallest overlap with which a set of n elements can reach the threshold."""
    return (NUM * n + DEN - 1) // DEN


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set as parities of its hashes' buckets: a power of two of bits, two to four for each element."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1)


def most_shared(n: int, a: bytes, m: int, b: bytes) -> int:
    """The most that two sets can share: each differing parity of their bitmaps is an element that only one has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, k), axis=0) for z in (x, y))
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def chunk_stats(batches, sequence: bool = False):
    """For each document its id, number of shingles (in a set, or in sequence), their digest and (of a set) its bitmap; for
    each chunk of documents what occurs in it more than once."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])
    cache, held, n = WordHashes(), [], 0

    def repeated():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        more = counts > 1
        none = [pa.nulls(int(more.sum()), f.type) for f in list(schema)[:4]]
        return pa.RecordBatch.from_arrays([*none, pa.array(tokens[more].view(np.int64)), pa.array(counts[more])], schema=schema)

    for batch in batches:
        sizes, sigs, bits = [], [], []
        for raw in batch["text"]:
            s = shingle_hashes(words(raw.as_py()), cache, WIDTH)
            s = s if sequence else np.unique(s)
            sizes.append(len(s))
            sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bits.append(bitmap(s).tobytes() if len(s) and not sequence else None)
            held.append(s)
            n += len(s)
            if n >= CHUNK:
                yield repeated()
                held, n = [], 0
        none = pa.nulls(len(sizes)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary()), none, none], schema=schema)
    if n:
        yield repeated()


class Order:
    """The shingles' order, and the choice of prefixes."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(frequent)
        self.frequent, self.counts = frequent[at], counts[at]

    def split(self, tokens: np.ndarray) -> np.ndarray:
        """The number of tasks that each token's list is dealt to."""
        at = np.minimum(np.searchsorted(self.frequent, tokens), max(len(self.frequent) - 1, 0))
        return np.where(self.frequent[at] == tokens, 1 + self.counts[at] // SPLIT, 1) if len(self.frequent) else np.ones(len(tokens), np.int64)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
        """The prefix of a sorted set and what its document's entries carry: the size, the matches asked for, how much
        the document shares with others, and its rare shingles in the prefix."""
        n = len(s)
        at = np.searchsorted(self.frequent, s)
        at[at == len(self.frequent)] = 0
        count = np.where(self.frequent[at] == s, self.counts[at], 0) if len(self.frequent) else np.zeros(n, np.int64)
        order = np.lexsort((s, count)) if count.any() else np.arange(n)
        least = needed(n)
        base, most = n - least, min(MAX_MATCH, least)
        others = np.maximum(count[order[: base + most]] - 1, 0)
        sums = np.cumsum(others)[base : base + most].astype(float)
        match = 1 + int(np.argmin(sums * (1 + VERIFY_COST / np.arange(1, most + 1)))) if sums[-1] else 1
        chosen = order[: base + match]
        rare = int(np.count_nonzero(count[chosen] == 0))
        about = {"n": n, "match": match, "weight": int(min(count.sum(), 0xFFFFFFFF)), "rare": min(rare, LAST), "all_rare": int(rare == np.count_nonzero(count == 0))}
        return s[chosen], about


def _prefixes(order: Order, keys: list[int]):
    def run(batches):
        cache, packer = WordHashes(), Packer(keys, ENTRY, DOC)
        for batch in batches:
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"]):
                s = np.unique(shingle_hashes(words(raw.as_py()), cache, WIDTH))
                if not len(s):
                    continue
                tokens, about = order.prefix(s)
                packer.add(tokens, {"pos": np.minimum(np.arange(len(tokens)), LAST)}, {"id": doc, **about}, order.split(tokens))
                if packer.full():
                    yield from packer.batches()
        yield from packer.batches()

    return run


ABOUT = ("id", "n", "match", "pos", "rare", "all_rare")
HUB = ("id", "n", "match", "pos", "rare", "all_rare")
LISTS = ", ".join(["token long", *(f"{c} long" for c in ABOUT), *(f"hub_{c} long" for c in HUB), "alive long"])


def _lists(order: Order):
    """Entries of shingles that several documents' prefixes have, each with its list's hub; and, in rows without a token,
    how many rare shingles of a document's prefix some other document of a fitting size has in its prefix (alive).

    Entries that no other entry of the list can be paired with are left out: where the next smaller and the next larger
    set are too far off in size, or the shingle stands too late for the smallest partner. Split lists keep all entries."""
    names = [x.split()[0] for x in LISTS.split(", ")]
    def counts(ids: np.ndarray):
        some, n = np.unique(ids, return_counts=True)
        cols = {"id": pa.array(some), "alive": pa.array(n)}
        return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(len(some), pa.int64())) for c in names], names=names)

    def run(batches):
        e = unpack(batches, ENTRY, DOC)
        if e is None:
            return
        e = _sorted(e, ("id", "n", "token"))
        n = e["n"].astype(np.int64)
        starts, sizes = runs(e["token"])
        near = (e["token"][1:] == e["token"][:-1]) & (DEN * n[:-1] >= NUM * n[1:])
        fit = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        yield counts(e["id"][fit & (e["pos"] < e["rare"])])
        partner = np.maximum(np.repeat(n[starts], sizes), (NUM * n + DEN - 1) // DEN)
        fit &= e["pos"].astype(np.int64) < n - -(-NUM * (n + partner) // (NUM + DEN)) + e["match"]
        split = np.repeat(order.split(e["token"][starts]) > 1, sizes)
        e["split"] = split
        e = _sorted({k: v[fit | split] for k, v in e.items()}, ("id", "weight", "token"))
        starts, sizes = runs(e["token"])
        many = np.repeat(sizes > 1, sizes) | e["split"]
        first = np.repeat(starts + sizes - 1, sizes)[many]
        cols = [e["token"].view(np.int64)[many], *(e[k][many].astype(np.int64) for k in ABOUT), *(e[k][first].astype(np.int64) for k in HUB)]
        yield from in_pieces(int(many.sum()), 100_000, lambda x: pa.RecordBatch.from_arrays([*(pa.array(c[x]) for c in cols), pa.nulls(len(cols[0][x]), pa.int64())], names=names))

    return run


def _sorted(e: dict[str, np.ndarray], by: tuple[str, ...]) -> dict[str, np.ndarray]:
    order = np.lexsort([e[k] for k in by])
    return {k: v[order] for k, v in e.items()}


def _within(a: str, b: str, matches: int | None = None):
    """Whether sets of sizes a_n and b_n can be close enough, and the places of a shared shingle are in the prefixes that
    this pair's overlap asks for (for so many matches; by default, as many as both ask for)."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    match = F.lit(matches) if matches else F.least(f"{a}match", f"{b}match")
    room = match - F.ceil(NUM * (n + m) / (NUM + DEN))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (F.col(f"{a}pos") < n + room) & (F.col(f"{b}pos") < m + room)


def _need():
    """The overlap that sets of n and m elements must have."""
    return F.ceil(NUM * (F.col("n") + F.col("m")) / (NUM + DEN))


def _candidates(met: DataFrame, a: str, b: str, alive: DataFrame) -> DataFrame:
    """Pairs (u, v) of met (a row for each shared shingle) that share enough, early enough, and whose rare shingles
    without any partner leave room for the overlap."""
    keys = [F.col(f"{a}id").alias("u"), F.col(f"{b}id").alias("v"), F.col(f"{a}n").alias("n"), F.col(f"{b}n").alias("m")]
    cols = [F.count("*").alias("k"), F.min(F.least(f"{a}match", f"{b}match")).alias("match"), F.min(f"{a}pos").alias("i"), F.min(f"{b}pos").alias("j")]
    more = [F.min(f"{a}rare").alias("u_rare"), F.min(f"{b}rare").alias("v_rare"), F.min(f"{a}all_rare").alias("u_all"), F.min(f"{b}all_rare").alias("v_all")]
    pairs = met.groupBy(*keys).agg(*cols, *more)
    enough = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _need()
    pairs = pairs.where((F.col("k") >= F.col("match")) & enough)
    for c, size, other in (("u", "n", "v"), ("v", "m", "u")):
        live = alive.select(F.col("id").alias(c), F.col("alive").alias(f"{c}_alive"))
        room = F.col(size) - F.col(f"{c}_rare") + F.coalesce(f"{c}_alive", F.lit(0)) >= _need()
        pairs = pairs.join(live, c, "left").where((F.col(f"{other}_all") == 0) | room)
    return pairs.select("u", "v").distinct()


def _sets(batches):
    """The set of each text, after the columns before it."""
    cache = WordHashes()
    for batch in batches:
        sets = [np.unique(shingle_hashes(words(raw.as_py()), cache, WIDTH)).tobytes() for raw in batch["text"]]
        keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sets, pa.binary())], names=[*(batch.schema.names[i] for i in keep), "set"])


def _alike(batches):
    """Pairs whose bitmaps leave room for the overlap."""
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("n", "a", "m", "b")))
        ok = [(NUM + DEN) * most_shared(n, a, m, b) >= NUM * (n + m) for n, a, m, b in rows]
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=("u", "v")).filter(pa.array(ok, pa.bool_()))


def alike(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs (u, v) without those that their documents' bitmaps rule out."""
    bits = stats.where("sig is not null")
    a, b = (bits.select(F.col("doc_id").alias(u), F.col("n").alias(n), F.col("bits").alias(x)) for u, n, x in (("u", "n", "a"), ("v", "m", "b")))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "n", "a", "m", "b")
    return both.mapInArrow(_alike, "u long, v long").distinct()


def _verify(batches):
    for batch in batches:
        ok = []
        for a, b in zip(batch["a"], batch["b"]):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            ok.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=("u", "v")).filter(pa.array(ok, pa.bool_()))


def frequent_shingles(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles that chunk_stats reports, and their counts."""
    counted = stats.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= MIN_FREQUENT)
    top = counted.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).toPandas()
    return top["token"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)


def classes(base: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n_shingles and class_id (the smallest doc_id of the same digest) of all rows; a row of base for each class (and
    other rows of its doc_id); and links (u, v) of classes that one doc_id has rows in."""
    seen = stats.where("token is null")
    n = seen.count()
    reps = stored(seen.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("class_id")), "classes", n)
    members = stored(seen.join(reps, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "members", n)
    by_id = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.max(F.col("class_id") == F.col("doc_id")).alias("leads"))
    copies = stored(by_id.where("lo != doc_id or hi != doc_id"), "copies", n)
    single = with_few(base.where("doc_id is not null"), copies.where("not leads").select("doc_id"), "left_anti")
    several = copies.where("lo != hi")
    links = members.join(several, "doc_id").where("class_id != lo").select(F.col("lo").alias("u"), F.col("class_id").alias("v")).distinct()
    return members, single, links


def with_few(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on doc_id; ids are broadcast if they are at most MAX_BROADCAST_IDS."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", how)


def verified(pairs: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """A table of those pairs (u, v) of documents whose sets reach the threshold.

    Sets are made where the texts are read: that of v goes to each u that it is paired with, that of u there once."""
    n = pairs.count()
    at = F.broadcast if n <= MAX_BROADCAST_IDS else (lambda df: df)
    partners = pairs.groupBy(F.col("v").alias("doc_id")).agg(F.collect_list("u").alias("us"))
    one = base.join(at(partners), "doc_id").select(F.col("doc_id").alias("v"), "us", "text").mapInArrow(_sets, "v long, us array<long>, set binary")
    two = base.join(at(pairs.select(F.col("u").alias("doc_id")).distinct()), "doc_id").select(F.col("doc_id").alias("u"), "text").mapInArrow(_sets, "u long, set binary")
    both = one.select(F.explode("us").alias("u"), "v", F.col("set").alias("b")).join(two.select("u", F.col("set").alias("a")), "u")
    return stored(both.select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long"), name, n, PAIRS_PER_TASK)


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most MAX_BROADCAST_IDS rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else df


def _apart(lists: DataFrame, label: DataFrame, alive: DataFrame) -> DataFrame:
    """Entries of lists that documents of several components have, as far as they can still be paired.

    All documents in the list of a frequent shingle have all their rare ones in their prefixes; so one whose rare shingles
    without partner are too many even for its smallest partner goes, and of two that are linked, one (strong) has room
    for a partner of its own size. A list of two that one shared shingle suffices for has been tried."""
    n = lists.count()
    bound = F.col("n") - F.col("rare") + F.coalesce("alive", F.lit(0))
    rare = F.col("pos") < F.col("rare")
    least = F.ceil(NUM * (F.col("n") + F.ceil(NUM * F.col("n") / DEN)) / (NUM + DEN))
    known = lists.join(_few(label.select(F.col("v").alias("id"), "label")), "id", "left").join(_few(alive), "id", "left")
    strong = rare | ((NUM + DEN) * bound >= 2 * NUM * F.col("n"))
    kept = stored(known.where(rare | (bound >= least)).select("token", *ABOUT, F.col("hub_id").alias("hub"), F.coalesce("label", "id").alias("label"), strong.alias("strong")), "kept", n)
    ends = [f(c).alias(f"{n}_{c}") for c in ("label", "hub") for n, f in (("lo", F.min), ("hi", F.max))]
    by_list = kept.groupBy("token").agg(*ends, F.count("*").alias("size"), F.min("match").alias("match"))
    apart = by_list.where("lo_label != hi_label AND NOT (size = 2 AND match = 1 AND lo_hub = hi_hub)").select("token")
    open_ = stored(kept.join(apart, "token", "left_semi"), "open", n)
    drop(kept)
    return open_


def _across(open_: DataFrame) -> DataFrame:
    """A row for each shared shingle of documents of different components that can be linked.

    Their first shared shingle stands where one match is asked for; pairs are formed there, and only for these the other
    shared shingles are looked up."""
    a, b = (open_.select("token", *[F.col(c).alias(f"{s}_{c}") for c in (*ABOUT, "hub", "label", "strong")]) for s in "ab")
    # A pair that one shared shingle suffices for was tried if either is the other's hub here: within implies enough for it.
    new = ~(((F.col("a_hub") == F.col("b_id")) | (F.col("b_hub") == F.col("a_id"))) & (F.least("a_match", "b_match") == 1))
    once = ~F.col("b_strong") | (F.col("a_id") < F.col("b_id"))
    other = F.col("a_label") != F.col("b_label")
    first = a.where("a_strong").join(b, "token").where(other & once & new & _within("a_", "b_", 1))
    pairs = first.select("a_id", "b_id").distinct()
    return pairs.join(a, "a_id").join(b, ["b_id", "token"]).where(_within("a_", "b_"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id: a row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    stats = stored(base.mapInArrow(chunk_stats, STATS), "stats")
    order = Order(*frequent_shingles(stats))
    members, single, same = classes(base, stats)
    parts = parts_for(spark, int((members.agg(F.sum("n_shingles")).first()[0] or 0) * (1 - NUM / DEN)))
    packed = single.mapInArrow(_prefixes(order, part_keys(spark, parts)), pack_fields(ENTRY, DOC))
    found = stored(deal(packed, parts).mapInArrow(_lists(order), LISTS), "lists")
    lists, n = found.where("token is not null").drop("alive"), found.count()
    alive = stored(found.where("token is null").groupBy("id").agg(F.sum("alive").alias("alive")), "alive", n)

    met = lists.where((F.col("id") != F.col("hub_id")) & _within("", "hub_"))
    stars = stored(alike(_candidates(met, "hub_", "", alive), stats), "stars", n)
    near = verified(stars, single, "near").unionByName(same)
    label = components(near)

    tried = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    open_ = _apart(lists, label, alive)
    pairs = _candidates(_across(open_), "a_", "b_", alive)
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    across = stored(alike(pairs, stats), "across", n)
    drop(found, alive, open_, stars)
    if not across.isEmpty():
        label = components(near.unionByName(verified(across, single, "links_across")))
    of = label.select(F.col("v").alias("class_id"), "label")
    return members.join(of, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"))
