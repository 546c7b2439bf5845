"""Substring deduplication by compact windows.

A text is a sequence of words. For each of HASHES orders of its TOKEN-word shingles, the Cartesian tree over the shingles'
hashes groups all passages by their smallest shingle: a node is a compact window, and every passage within it that holds
the node's place has that shingle as its min-hash. Only nodes wide enough for a passage of MIN_WORDS words are made, some
2n / MIN_WORDS, as runs of passages of that length with one smallest place; block minima give them in linear time. Texts
that share a passage have, in each order, windows of one min-hash (a list) that hold it.

Interval join: in its list a window meets the first document's window (the hub; the hub's further windows meet the
second document's). The windows of a document and its hub, of all orders, that lie close together on near diagonals are
one candidate: an interval of each document. Only the words of candidate intervals (and MARGIN more) leave the texts. Exact runs of WIDTH words on
the matched diagonals and on those near them are chained; a chain whose sets of WIDTH-word shingles have similarity
0.75 or more is a passage, and so is any exact run of MIN_WORDS words; where a chain fails as a whole, its longest stretches of runs whose
aligned shingles reach 0.75 are judged. Words are compared, not hashes.

A window is left over where its min-hash's place is in no passage found: its list may be of texts that share less than a passage, as a
common line. Lists are not expanded into their pairs. Instead, what is left over is listed anew by two orders: with every
window of another order that some passage is in, too, and meets the first document of the list of both min-hashes. And since all passages of
MIN_WORDS words that two documents have are in windows of shared lists in all orders, those that are, and are in windows left
over, are compared exactly, grouped by a hash of their words: no exact repeat is lost. A pair of near passages that share
a share j of their TOKEN-word shingles is in a common list with a chance of 1 - (1 - j) ** HASHES; where that list's first document has no passage
in common with them, they are found if a second order agrees as well.

Windows go to the tasks that own ranges of min-hashes. A min-hash that many documents of one chunk have is paired with
a hub of the chunk where the texts are read, and only that hub goes on, so no task gathers a frequent passage.

Result: a row for each passage found in a document, with one other document that has it: doc_id, start, end (words, end
exclusive), other_id, other_start, other_end, words, similarity. Documents without repeated passages have no row; equal
texts meet only through their class, and each copy has a row for its whole text.

Defined results: null, empty and short texts have no passages; repeats within one document are not reported for its sake alone; null
doc_ids are left out; rows that repeat a doc_id are one document; a text of one word over and over is a few windows; very
long texts are read whole, in time and memory linear in their words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, drop, mix, shingle_hashes, stored, whole, words
from .ngram_join import classes, with_few
from .packing import Packer, deal, in_pieces, pack_fields, part_keys, parts_for, runs, unpack

MIN_WORDS, WIDTH, TOKEN, HASHES, SIMILARITY = 50, 5, 8, 4, 0.75
DRIFT, GAP = 8, 12
#: Candidate intervals: windows this near each other are one; words added on either side; places are rounded to these.
NEAR, MARGIN, ROUND = 50, 24, 16
#: A min-hash that so many documents of a chunk have gets a hub there; a chunk's windows.
LOCAL, CHUNK_WINDOWS, MAX_BROADCAST = 16, 250_000, 200_000
#: A window: its first passage's start, how many more starts, its min-hash's place after the first start; of a window that has met a hub of
#: its chunk (star), the hub and the place there.
ENTRY, DOC = {"start": "u4", "more": "u1", "off": "u1", "order": "u1", "star": "u1", "hub": "i8", "hub_at": "u4"}, {"id": "i8"}
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (the leftmost of equal ones) of each run of width values, by block minima."""
    n = len(values)
    bits = np.uint64(int(n - 1).bit_length())
    keyed = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keyed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last start and the smallest place of the runs of passages of width values that have one smallest place: the nodes of the
    Cartesian tree over values that are at least width wide, as far as passages of that width reach from their places."""
    at = smallest_places(values, width)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return first, last, at[first]


def windows(tokens: list[bytes], cache: WordHashes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Min-hashes of a text's compact windows in all orders, and the windows. Windows in a row that have one min-hash (of texts
    that repeat themselves) are one, up to 256 starts."""
    width = MIN_WORDS - TOKEN + 1
    s = shingle_hashes(tokens, cache, TOKEN)
    keys, starts, mores, offs, orders = [], [], [], [], []
    for order, seed in enumerate(SEEDS[:HASHES]):
        first, last, at = compact_windows(mix(s ^ seed), width)
        key = mix(s[at] ^ seed)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = first[new]
        tail = last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(key) - 1]])]
        pieces = (tail - head) // 256 + 1
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = np.repeat(head, pieces) + 256 * step
        keys.append(np.repeat(key[new], pieces))
        starts.append(lo)
        mores.append(np.minimum(np.repeat(tail, pieces) - lo, 255))
        offs.append(np.where(step == 0, np.repeat(at[new], pieces) - lo, 0))
        orders.append(np.full(len(lo), order))
    return np.concatenate(keys), {"start": np.concatenate(starts), "more": np.concatenate(mores), "off": np.concatenate(offs), "order": np.concatenate(orders)}


def _digests(batches):
    """doc_id, number of words and digest of each text."""
    for batch in batches:
        found = [(len(w), hashlib.blake2b(b" ".join(w), digest_size=16).digest()) for w in (words(raw.as_py()) for raw in batch["text"])]
        n, sig = [len_ for len_, _ in found], [d if len_ else None for len_, d in found]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(len(n), pa.int64())], names=("doc_id", "n", "sig", "token"))


def _partners(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows sorted by token and document: the list's number of documents, whether the window is its list's first, and
    the window that each meets (the first of another document than its own among the list's first two)."""
    starts, sizes = runs(token)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    new[starts] = True
    docs = np.repeat(np.add.reduceat(new.astype(np.int64), starts), sizes)
    first = np.repeat(starts, sizes)
    nth = np.cumsum(new)
    nth -= np.repeat(nth[starts], sizes)
    places = np.flatnonzero(new)
    second = places[np.minimum(np.searchsorted(places, first) + 1, len(places) - 1)]
    return docs, np.arange(len(token)) == first, np.where(nth > 0, first, second)


class _Chunk:
    """Windows of a chunk of documents; pairs frequent min-hashes with a hub of the chunk, and hands all to a Packer."""

    def __init__(self, keys: list[int]) -> None:
        self.packer = Packer(keys, ENTRY, DOC)
        self.clear()

    def clear(self) -> None:
        self.tokens, self.found, self.ids, self.n = [], {"start": [], "more": [], "off": [], "order": []}, [], 0

    def add(self, doc: int, tokens: np.ndarray, found: dict[str, np.ndarray]) -> None:
        self.tokens.append(tokens)
        for k, v in found.items():
            self.found[k].append(v)
        self.ids.append(np.full(len(tokens), doc))
        self.n += len(tokens)

    def batches(self):
        if not self.n:
            return
        token, ids = np.concatenate(self.tokens), np.concatenate(self.ids)
        e = {k: np.concatenate(v) for k, v in self.found.items()}
        self.clear()
        order = np.lexsort((e["start"], ids, token))
        token, ids, e = token[order], ids[order], {k: v[order] for k, v in e.items()}
        docs, first, partner = _partners(token, ids)
        star = (docs >= LOCAL) & ~first
        e["star"] = star
        e["hub"] = np.where(star, ids[partner], 0)
        e["hub_at"] = np.where(star, (e["start"] + e["off"])[partner], 0)
        order = np.argsort(ids, kind="stable")
        token, ids, e = token[order], ids[order], {k: v[order] for k, v in e.items()}
        starts, sizes = runs(ids)
        for lo, n in zip(starts.tolist(), sizes.tolist()):
            self.packer.add(token[lo : lo + n], {k: v[lo : lo + n] for k, v in e.items()}, {"id": int(ids[lo])})
        yield from self.packer.batches()


def _windows(keys: list[int]):
    def run(batches):
        cache, chunk = WordHashes(), _Chunk(keys)
        for batch in batches:
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"]):
                w = words(raw.as_py())
                if len(w) >= MIN_WORDS:
                    chunk.add(doc, *windows(w, cache))
                    if chunk.n >= CHUNK_WINDOWS:
                        yield from chunk.batches()
        yield from chunk.batches()

    return run


LISTS = "token long, id long, at int, lo int, hi int, order int, hub long, hub_at int, docs long"


def _meet(batches):
    """Windows that meet a hub: the list (token), the window's document, min-hash's place, first and last start, the hub, the
    min-hash's place there, and the list's number of documents. A list's first window meets none (hub_at -1)."""
    e = unpack(batches, ENTRY, DOC)
    if e is None:
        return
    order = np.lexsort((e["start"], e["id"], e["token"]))
    e = {k: v[order] for k, v in e.items()}
    star = e["star"] == 1
    at = e["start"].astype(np.int64) + e["off"]
    hub, hub_at, docs, some = e["hub"].copy(), e["hub_at"].astype(np.int64), np.full(len(at), LOCAL), star.copy()
    rest = np.flatnonzero(~star)
    if len(rest):
        n, first, partner = _partners(e["token"][rest], e["id"][rest])
        hub[rest], hub_at[rest], docs[rest], some[rest] = e["id"][rest][partner], np.where(first, -1, at[rest][partner]), n, n > 1
    cols = [e["token"].view(np.int64), e["id"], at.astype(np.int32), e["start"].astype(np.int32), (e["start"].astype(np.int64) + e["more"]).astype(np.int32), e["order"].astype(np.int32), hub, hub_at.astype(np.int32), docs]
    cols, names = [c[some] for c in cols], [x.split()[0] for x in LISTS.split(", ")]
    yield from in_pieces(int(some.sum()), 100_000, lambda x: pa.RecordBatch.from_arrays([pa.array(c[x]) for c in cols], names=names))


INTERVALS = "id long, lo int, hi int, hub long, hub_lo int, hub_hi int, ms array<struct<i: int, j: int>>"


def intervals(ms: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Candidates (lo, hi, other lo, other hi, matches) from matches (place, other place, first start, last start): those close
    together on near diagonals are one."""
    out: list[list] = []
    for i, j, lo, hi in sorted(ms, key=lambda m: (m[2], m[0], m[1])):
        d = i - j
        for c in reversed(out[-8:]):  # what lies further back is a candidate of its own; verification merges equal finds
            if abs(c[2] - d) <= DRIFT and lo <= c[1] + NEAR:
                c[1], c[2] = max(c[1], hi), d
                c[3], c[4] = min(c[3], d), max(c[4], d)
                c[5].append((i, j))
                break
        else:
            out.append([lo, hi, d, d, d, [(i, j)]])
    return [(lo, hi + MIN_WORDS, max(0, lo - most), hi + MIN_WORDS - least, found) for lo, hi, _, least, most, found in out]


def _intervals(batches):
    names = [x.split()[0] for x in ("id", "lo", "hi", "hub", "hub_lo", "hub_hi", "ms")]
    m_type = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), m_type)
    for batch in batches:
        out = []
        for doc, hub, ms in zip(batch["id"].to_pylist(), batch["hub"].to_pylist(), batch["ms"].to_pylist()):
            for lo, hi, lo2, hi2, found in intervals([(m["at"], m["hub_at"], m["lo"], m["hi"]) for m in ms]):
                down, up = (lambda x: max(0, x - MARGIN) // ROUND * ROUND), (lambda x: -(-(x + MARGIN) // ROUND) * ROUND)
                a, b = down(lo), down(lo2)
                out.append((doc, a, up(hi), hub, b, up(hi2), [{"i": i - a, "j": j - b} for i, j in dict.fromkeys(found)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _slices(batches):
    """The words wanted of each text."""
    for batch in batches:
        out = []
        for doc, raw, parts in zip(batch["doc_id"].to_pylist(), batch["text"], batch["parts"].to_pylist()):
            w = words(raw.as_py())
            out += [(doc, p["lo"], p["hi"], b" ".join(w[p["lo"] : p["hi"]])) for p in parts]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=("id", "lo", "hi", "slice"))


def numbered(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal where the words are."""
    at: dict[bytes, int] = {}
    return tuple(np.fromiter((at.setdefault(w, len(at)) for w in z), np.uint64, len(z)) for z in (x, y))


def _grams(x: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(x) - WIDTH + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WIDTH):
            out = out * np.uint64(0x9E3779B97F4A7C15) + x[i : len(out) + i]
    return np.unique(out)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    a, b = _grams(x), _grams(y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


class _Runs:
    """Exact runs of at least WIDTH words of x and y, by diagonal (place in x less place in y)."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y, self.of = x, y, {}

    def on(self, d: int) -> tuple[list[int], list[int]]:
        if d not in self.of:
            lo, hi = max(0, d), min(len(self.x), len(self.y) + d)
            ends = np.concatenate([[lo - 1], lo + np.flatnonzero(self.x[lo:hi] != self.y[lo - d : hi - d]), [hi]]) if lo < hi else np.zeros(1, np.int64)
            long = np.flatnonzero(np.diff(ends) > WIDTH)
            self.of[d] = (ends[long] + 1).tolist(), ends[long + 1].tolist()
        return self.of[d]

    def at(self, d: int, i: int) -> tuple[int, int] | None:
        starts, ends = self.on(d)
        k = bisect_right(starts, i) - 1
        return (starts[k], ends[k]) if k >= 0 and i < ends[k] else None

    def after(self, lo: int, hi: int, d: int) -> tuple[int, int, int] | None:
        """The run that carries (lo, hi, d) on to the right: the one that begins first, on the nearest diagonal."""
        best = None
        for e in range(d - DRIFT, d + DRIFT + 1):
            starts, ends = self.on(e)
            k = bisect_right(ends, max(hi, hi - d + e))
            if k < len(starts) and lo < starts[k] <= hi + GAP and lo - d < starts[k] - e <= hi - d + GAP:
                best = min(best or (starts[k] + 1,), (starts[k], abs(e - d), e, ends[k]))
        return best and (best[0], best[3], best[2])

    def before(self, lo: int, hi: int, d: int) -> tuple[int, int, int] | None:
        best = None
        for e in range(d - DRIFT, d + DRIFT + 1):
            starts, ends = self.on(e)
            k = bisect_left(starts, min(lo, lo - d + e)) - 1
            if k >= 0 and lo - GAP <= ends[k] < hi and lo - d - GAP <= ends[k] - e < hi - d:
                best = min(best or (1 - ends[k],), (-ends[k], abs(e - d), e, starts[k]))
        return best and (best[3], -best[0], best[2])


def _stretches(chain: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, last) runs of the longest stretches whose aligned shingles reach SIMILARITY."""
    lo, hi, d = np.array(chain, np.int64).T
    shared = np.concatenate([[0], np.cumsum(hi - lo - WIDTH + 1)])
    out, best = [], -1
    for a in range(len(chain)):
        both = (hi[a:] - lo[a]) + (hi[a:] - d[a:] - lo[a] + d[a]) - 2 * (WIDTH - 1)
        m = shared[a + 1 :] - shared[a]
        good = np.flatnonzero(m >= SIMILARITY * (both - m))
        if len(good) and a + int(good[-1]) > best:
            best = a + int(good[-1])
            out.append((a, best))
    return out


def passages(x: np.ndarray, y: np.ndarray, matches: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Repeated passages (start, end, other start, other end, similarity) of x in y, from matches (place, other place)."""
    found, chains, seen = _Runs(x, y), [], set()
    for i, j in sorted(matches):
        run = found.at(i - j, i)
        if run is None or (*run, i - j) in seen:
            continue
        chain = [(*run, i - j)]
        while more := found.after(*chain[-1]):
            chain.append(more)
        chain.reverse()
        while more := found.before(*chain[-1]):
            chain.append(more)
        chain.reverse()
        seen |= set(chain)
        chains.append(chain)
    out: list[tuple[int, int, int, int, float]] = []

    def judge(part: list[tuple[int, int, int]]) -> bool:
        (lo, _, d), (_, hi, e) = part[0], part[-1]
        lo2, hi2 = lo - d, hi - e
        short = MIN_WORDS - min(hi - lo, hi2 - lo2)  # changed words at the ends belong to a passage, too
        if short > 0:
            right = min(short, len(x) - hi, len(y) - hi2)
            left = min(short - right, lo, lo2)
            if left + right < short:
                return False
            lo, hi, lo2, hi2 = lo - left, hi + right, lo2 - left, hi2 + right
        s = similarity(x[lo:hi], y[lo2:hi2])
        if s >= SIMILARITY:
            out.append((lo, hi, lo2, hi2, s))
        return s >= SIMILARITY

    for chain in chains:
        if len(chain) == 1 and chain[0][1] - chain[0][0] >= MIN_WORDS:
            continue
        if not judge(chain) and len(chain) > 1:
            for a, b in _stretches(chain):
                judge(chain[a : b + 1])
    for lo, hi, d in sorted(set().union(*chains)):  # exact runs that no passage holds
        if hi - lo >= MIN_WORDS and not any(a <= lo and hi <= b and a2 <= lo - d and hi - d <= b2 for a, b, a2, b2, _ in out):
            out.append((lo, hi, lo - d, hi - d, 1.0))
    return out


FOUND = "doc_id long, start int, end int, other_id long, other_start int, other_end int, words int, similarity double"


def _verify(batches):
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    for batch in batches:
        out = []
        for doc, lo, other, lo2, ms, a, b in zip(*(batch[c].to_pylist() for c in ("id", "lo", "hub", "hub_lo", "ms")), batch["a"], batch["b"]):
            x, y = numbered(a.as_py().split(b" "), b.as_py().split(b" "))
            for s, e, s2, e2, sim in passages(x, y, [(m["i"], m["j"]) for m in ms]):
                out.append((doc, lo + s, lo + e, other, lo2 + s2, lo2 + e2, e - s, sim))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def verified(met: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """Passages of the pairs of windows met (id, at, lo, hi, hub, hub_at): rows as FOUND."""
    by_pair = met.groupBy("id", "hub").agg(F.collect_set(F.struct("at", "hub_at", "lo", "hi")).alias("ms"))
    found = stored(by_pair.mapInArrow(_intervals, INTERVALS), name + "_intervals")
    wanted = found.select(F.col("id").alias("doc_id"), "lo", "hi").unionByName(found.select(F.col("hub").alias("doc_id"), F.col("hub_lo").alias("lo"), F.col("hub_hi").alias("hi"))).distinct()
    parts = stored(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")), name + "_wanted")
    few = parts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    slices = stored(base.join(F.broadcast(parts) if few else parts, "doc_id").select("doc_id", "text", "parts").mapInArrow(_slices, "id long, lo int, hi int, slice binary"), name + "_slices")
    both = found.join(slices.withColumnRenamed("slice", "a"), ["id", "lo", "hi"]).join(slices.select(F.col("id").alias("hub"), F.col("lo").alias("hub_lo"), F.col("hi").alias("hub_hi"), F.col("slice").alias("b")), ["hub", "hub_lo", "hub_hi"])
    passages_ = stored(both.select("id", "lo", "hub", "hub_lo", "ms", "a", "b").mapInArrow(_verify, FOUND), name)
    drop(found, parts, slices)
    return passages_


def left_over(met: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of met (id, at, ...) whose place is in no passage found in their document."""
    spans = found.select(F.col("doc_id").alias("id"), "start", "end").unionByName(found.select(F.col("other_id").alias("id"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))
    held = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    inside = F.exists("spans", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["end"]))
    return met.join(held, "id", "left").where(~F.coalesce(inside, F.lit(False))).drop("spans")


def by_two_orders(rest: DataFrame, lists: DataFrame) -> DataFrame:
    """Windows left over (id, at, lo, hi) that meet (hub, hub_at) the first document of a list of two orders' min-hashes."""
    spread = lambda df: df.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))))
    near = spread(lists.join(rest.select("id").distinct(), "id", "left_semi")).select("id", "cell", F.col("token").alias("token2"), F.col("order").alias("order2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = spread(rest.select("token", "id", "at", "lo", "hi", "order")).join(near, ["id", "cell"]).where("order != order2 AND lo <= hi2 AND lo2 <= hi")
    keyed = both.select(F.xxhash64("token", "token2").alias("key"), "id", "at", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")).distinct()
    keyed = stored(keyed, "keyed")
    first = keyed.groupBy("key").agg(F.min(F.struct("id", "at")).alias("o"), F.max("id").alias("last")).where("o.id != last")
    met = keyed.join(first.select("key", F.col("o.id").alias("hub"), F.col("o.at").alias("hub_at")), "key")
    return met.where("id != hub").select("id", "at", "lo", "hi", "hub", "hub_at").distinct()


def _all_orders(batches):
    """Ranges of starts that windows of all orders, and a window left over, hold: doc_id, parts."""
    for batch in batches:
        out = []
        for doc, ws in zip(batch["id"].to_pylist(), batch["ws"].to_pylist()):
            edge = np.zeros((HASHES + 1, max(w["hi"] for w in ws) + 3), np.int32)
            for w in ws:
                row = HASHES if w["rest"] else w["order"]
                edge[row, w["lo"] + 1] += 1
                edge[row, w["hi"] + 2] -= 1
            held = (np.cumsum(edge, axis=1) > 0).all(axis=0).astype(np.int8)
            turns = np.flatnonzero(np.diff(held)).reshape(-1, 2).tolist() if held.any() else []
            if turns:
                out.append((doc, [{"lo": lo, "hi": hi} for lo, hi in turns]))
        if out:
            part = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), part))], names=("doc_id", "parts"))


def _exact(batches):
    """Hashes of the passages of MIN_WORDS words that start in the ranges given."""
    for batch in batches:
        for doc, raw, parts in zip(batch["doc_id"].to_pylist(), batch["text"], batch["parts"].to_pylist()):
            w = words(raw.as_py())
            starts = [i for p in parts for i in range(p["lo"], min(p["hi"], len(w) - MIN_WORDS + 1))]
            h = [int.from_bytes(hashlib.blake2b(b" ".join(w[i : i + MIN_WORDS]), digest_size=8).digest(), "little", signed=True) for i in starts]
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([doc] * len(h), pa.int64()), pa.array(starts, pa.int32())], names=("h", "id", "start"))


def exact_repeats(rest: DataFrame, lists: DataFrame, base: DataFrame) -> DataFrame:
    """Passages of MIN_WORDS words left over that another document has, too: rows as FOUND, those in a row as one where they have one other."""
    of = lists.join(rest.select("id").distinct(), "id", "left_semi").select("id", "lo", "hi", "order", F.lit(False).alias("rest")).unionByName(rest.select("id", "lo", "hi", "order", F.lit(True).alias("rest")))
    wanted = stored(of.groupBy("id").agg(F.collect_set(F.struct("lo", "hi", "order", "rest")).alias("ws")).mapInArrow(_all_orders, "doc_id long, parts array<struct<lo: int, hi: int>>"), "ranges")
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    grams = stored(base.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "parts").mapInArrow(_exact, "h long, id long, start int"), "grams")
    ends = grams.groupBy("h").agg(F.min(F.struct("id", "start")).alias("lo"), F.max(F.struct("id", "start")).alias("hi")).where("lo.id != hi.id")
    met = grams.join(ends, "h").select("id", "start", F.when(F.col("id") == F.col("lo.id"), F.col("hi")).otherwise(F.col("lo")).alias("o"))
    runs_ = met.select("id", "start", F.col("o.id").alias("other"), (F.col("o.start") - F.col("start")).alias("shift"))
    row = F.col("start") - F.row_number().over(Window.partitionBy("id", "other", "shift").orderBy("start"))
    one = runs_.withColumn("row", row).groupBy("id", "other", "shift", "row").agg(F.min("start").alias("start"), (F.max("start") + MIN_WORDS).alias("end"))
    return one.select(F.col("id").alias("doc_id"), "start", "end", F.col("other").alias("other_id"), (F.col("start") + F.col("shift")).alias("other_start"), (F.col("end") + F.col("shift")).alias("other_end"), (F.col("end") - F.col("start")).alias("words"), F.lit(1.0).alias("similarity"))


def turned(found: DataFrame) -> DataFrame:
    """The same passages, told of the other document."""
    return found.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end"), F.col("doc_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), (F.col("other_end") - F.col("other_start")).alias("words"), "similarity")


def of_copies(members: DataFrame) -> DataFrame:
    """Whole texts that several documents have."""
    long = members.where(F.col("n_shingles") >= MIN_WORDS).withColumn("words", F.col("n_shingles").cast("int"))
    copies = long.where("doc_id != class_id").select("doc_id", F.col("class_id").alias("other_id"), "words")
    firsts = copies.groupBy(F.col("other_id").alias("doc_id"), "words").agg(F.min("doc_id").alias("other_id")).select("doc_id", "other_id", "words")
    zero = F.lit(0)
    return copies.unionByName(firsts).select("doc_id", zero.alias("start"), F.col("words").alias("end"), "other_id", zero.alias("other_start"), F.col("words").alias("other_end"), "words", F.lit(1.0).alias("similarity"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The rows described above, for docs (doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    stats = stored(base.mapInArrow(_digests, "doc_id long, n long, sig binary, token long"), "stats")
    members, single, _ = classes(base, stats)
    expected = int((members.agg(F.sum("n_shingles")).first()[0] or 0) * 2 * HASHES // MIN_WORDS)
    parts = parts_for(spark, expected)
    packed = single.mapInArrow(_windows(part_keys(spark, parts)), pack_fields(ENTRY, DOC))
    lists = stored(deal(packed, parts).mapInArrow(_meet, LISTS), "lists")
    met = lists.where("hub_at >= 0")
    found = verified(met, single, "found")

    rest = stored(left_over(lists.where("docs > 2"), found), "rest")
    if not rest.isEmpty():
        more = verified(by_two_orders(rest, lists), single, "more")
        found = found.unionByName(more)
        rest = stored(left_over(rest, more), "still")
        found = found.unionByName(stored(exact_repeats(rest, lists, single), "repeats"))

    rows = found.unionByName(turned(found)).unionByName(of_copies(members))
    cols = ("other_id", "other_start", "other_end", "words", "similarity")
    return rows.groupBy("doc_id", "start", "end").agg(F.min(F.struct(*cols)).alias("o")).select("doc_id", "start", "end", "o.*")
