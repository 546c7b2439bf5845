"""Language-model scores from a lattice of all subword segmentations.

The pieces and their scores come from an existing vocabulary file (its path is a parameter; only the driver reads it). A
word, with the word mark before it, has the probability of all its segmentations together, summed in log space by
forward recursion over the positions of many words at once: a piece that begins a word, further pieces, and a stop. A
character that no piece covers has a share of the unknown piece's weight. A text is words and an end: each word weighs its marginal
probability times the chance that a text goes on, so the probabilities of all texts add up to 1; score is the logarithm of a text's.

Scores of the file give the pieces' first weights: log probabilities as they are where the file is a unigram vocabulary; the file at hand is a merge
vocabulary, whose scores are negative ranks, so a piece weighs 1 / (ZIPF - score), by Zipf's law. The training rows then adapt
the weights, for EM_STEPS rounds: expected counts of pieces over all words of the corpus (forward-backward, each word as often as it
occurs) are added to SHARE times as many counts dealt by the file's weights, so the file's scores keep SHARE / (1 + SHARE) of the weight
however large the corpus is. A piece table (at most MAX_PIECES entries) is what is broadcast of it.

The base score needs the counts of all words. They grow with the corpus and are never broadcast as a whole: the HEAD most
frequent words are, and every other word of a document is joined with the table of counts.

Words longer than LONG characters are scored in blocks that hand on the last positions' sums, so memory stays bounded however long an
unbroken text is; to the adaptation they count as their pieces of LONG characters.

Defined results: null and empty texts have one token, the end; rows that repeat a doc_id are each scored; a null doc_id
is in the fold of the empty text; without training rows N = V = 0, every token is unknown, and the file's own weights score; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored, whole, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, CHUNK_TOKENS, CACHE = 200_000, 2_000_000, 400_000
EM_STEPS, SHARE, ZIPF, MAX_PIECES, MARK = 2, 1.0, 10.0, 300_000, "▁"
CELLS, CHARACTERS, LONG = 60_000, 1_114_112, 2048


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Pieces and their log weights by the file's scores; control, unknown and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if len(ids) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    pieces, scores = [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids], float)
    if MARK not in pieces:
        pieces, scores = [*pieces, MARK], np.append(scores, scores.min(initial=0.0))
    ranks = np.all(scores == np.round(scores))  # a merge vocabulary's
    return pieces, -np.log(ZIPF - scores) if ranks else scores


class Lattice:
    """Marginal log probabilities (natural) of words under weights of pieces; the last two are the unknown piece's and the stop's."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, pieces: list[str], log_weights: np.ndarray) -> None:
        self.weights = np.asarray(log_weights, float)
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * self.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            by.setdefault(len(p), []).append((h, i))
        self.tables = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(xs)), (np.uint64, np.int64))) for n, xs in by.items()}

    def _arcs(self, w: np.ndarray) -> np.ndarray:
        """Piece numbers of all substrings of w (words x characters): words x ends x lengths; -1: no such piece."""
        rows, n = w.shape
        most = min(n, self.longest)
        out = np.full((rows, n, most), -1, np.int64)
        h = np.zeros((rows, n + 1), np.uint64)
        with np.errstate(over="ignore"):
            base, power = np.uint64(self.BASE), np.uint64(1)
            for i in range(n):
                h[:, i + 1] = h[:, i] * base + w[:, i] + np.uint64(1)
            for k in range(1, most + 1):
                power = power * base
                if k in self.tables:
                    hashes, ids = self.tables[k]
                    want = h[:, k:] - h[:, :-k] * power
                    at = np.minimum(np.searchsorted(hashes, want), len(hashes) - 1)
                    out[:, k - 1 :, k - 1] = np.where(hashes[at] == want, ids[at], -1)
        first = out[:, :, 0]
        first[first < 0] = self.unknown
        return out

    def _forward(self, logs: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """log sums over segmentations of prefixes. logs: words x ends x lengths; before: the sums of the first positions."""
        rows, n, most = logs.shape
        a = np.zeros((rows, n + 1))
        known = 1 if before is None else len(before)
        if before is not None:
            a[0, :known] = before
        for e in range(known, n + 1):
            k = min(e, most)
            x = logs[:, e - 1, :k] + a[:, e - k : e][:, ::-1]
            top = x.max(axis=1)
            a[:, e] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return a

    def _groups(self, tokens: list[str]):
        """Blocks of words of one length: their places and characters."""
        by: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            by.setdefault(len(t), []).append(i)
        for n, at in by.items():
            step = max(1, CELLS // n)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                yield np.array(part), np.frombuffer("".join([tokens[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.uint64)

    def _logs(self, arcs: np.ndarray) -> np.ndarray:
        logs = np.where(arcs >= 0, self.weights[arcs], -np.inf)
        logs[arcs == self.unknown] -= math.log(CHARACTERS)
        return logs

    def _long(self, token: str) -> float:
        """The forward sum of a long word, in blocks."""
        held, at = np.zeros(1), 0  # sums of positions at, at + 1, ...
        while at + len(held) - 1 < len(token):
            part = token[at : at + len(held) - 1 + LONG]
            w = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)[None]
            a = self._forward(self._logs(self._arcs(w)), held)[0]
            drop = max(0, len(a) - self.longest)
            held, at = a[drop:], at + drop
        return float(held[-1])

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log probabilities of words, given with their mark."""
        out = np.zeros(len(tokens))
        for i, t in enumerate(tokens):
            if len(t) > LONG:
                out[i] = self._long(t) + self.weights[-1]
        short = np.array([i for i, t in enumerate(tokens) if len(t) <= LONG], np.int64)
        for places, w in self._groups([tokens[i] for i in short]):
            at = short[places]
            out[at] = self._forward(self._logs(self._arcs(w)))[:, -1] + self.weights[-1]
        return out

    def expected(self, tokens: list[str], times: np.ndarray) -> np.ndarray:
        """Expected numbers of uses of each piece, the unknown piece and the stop, in words that occur so many times."""
        total = np.zeros(len(self.weights))
        for at, w in self._groups(tokens):
            arcs = self._arcs(w)
            logs = self._logs(arcs)
            rows, n, most = arcs.shape
            a = self._forward(logs)
            flipped = np.full_like(logs, -np.inf)  # the same arcs, read from the end
            for k in range(1, most + 1):
                flipped[:, k - 1 :, k - 1] = logs[:, k - 1 :, k - 1][:, ::-1]
            b = self._forward(flipped)[:, ::-1]
            for k in range(1, most + 1):
                x = np.exp(a[:, : n - k + 1] + logs[:, k - 1 :, k - 1] + b[:, k:] - a[:, -1:])
                ids = arcs[:, k - 1 :, k - 1]
                x *= times[at][:, None]
                total += np.bincount(ids[ids >= 0], x[ids >= 0], len(total))
        total[-1] = times.sum()
        return total


def marked(word: bytes) -> str:
    return MARK + word.decode("utf-8", "replace")


def _count(batches):
    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=("word", "n"))

    seen, n = Counter(), 0
    for batch in batches:
        for raw in batch["text"]:
            w = words(raw.as_py())
            seen.update(w)
            n += len(w)
            if n >= CHUNK_TOKENS:
                yield rows()
                seen, n = Counter(), 0
    if seen:
        yield rows()


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes), n: counts over whole texts."""
    return train.select(whole().alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def normalised(weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log weights: pieces that begin a word add up to 1, and so do the others with the unknown piece and the stop."""
    return np.log(weights) - np.log(np.where(begins, weights[begins].sum(), weights[~begins].sum()))


def first_weights(pieces: list[str], log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the pieces, the unknown piece (as the least) and the stop (a third of what goes on), and which begin a word."""
    begins = np.array([p.startswith(MARK) for p in pieces] + [False, False])
    w = np.maximum(np.exp(log_weights - log_weights.max(initial=-np.inf)), 1e-30) if len(pieces) else np.zeros(0)
    w = np.concatenate([w, [w.min(initial=1.0), 0.0]])
    w[-1] = 0.5 * w[~begins].sum()
    return w, begins


def fit(counts: DataFrame, pieces: list[str], log_weights: np.ndarray, steps: int = EM_STEPS, share: float = SHARE) -> np.ndarray:
    """Log weights of pieces, the unknown piece and the stop, adapted to the words of counts (word, n).

    Pieces that begin a word, and all others, each have share times their uses in the corpus dealt by the file's weights."""
    first, begins = first_weights(pieces, log_weights)
    logs = normalised(first, begins)
    own = np.exp(logs)
    for _ in range(steps):

        def expect(batches, weights=logs):
            lattice, total = Lattice(pieces, weights), np.zeros(len(weights))
            for batch in batches:
                ws, ns = map(marked, batch["word"].to_pylist()), batch["n"].to_numpy()
                cut = [(w[lo : lo + LONG], n) for w, n in zip(ws, ns) for lo in range(0, len(w), LONG)]
                for lo in range(0, len(cut), 20_000):
                    part = cut[lo : lo + 20_000]
                    total += lattice.expected([w for w, _ in part], np.array([n for _, n in part], float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=("piece", "n"))

        got = counts.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        if got.empty:
            break
        uses = np.zeros(len(own))
        uses[got["piece"].to_numpy(int)] = got["n"].to_numpy(float)
        dealt = share * np.where(begins, uses[begins].sum(), uses[~begins].sum())
        logs = normalised(uses + dealt * own, begins)
    return logs


SCORED = "doc_id long, n_tokens long, log_c double, n_known long, score double, rare array<struct<word: binary, k: int>>"


def _score(pieces: list[str], logs: np.ndarray, head: dict[bytes, int], ends: int, tokens: int):
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32())]))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), rare_type)
    names = ("doc_id", "n_tokens", "log_c", "n_known", "score", "rare")
    end = ends / tokens if ends else 0.5
    stop, go = math.log10(end), math.log10(1 - end) if end < 1 else 0.0

    def run(batches):
        lattice, at = Lattice(pieces, logs), {}
        score, c = np.zeros(0), np.zeros(0)

        def learn(new: list[bytes]):
            nonlocal score, c
            if len(at) + len(new) > CACHE:
                at.clear()
                score, c = np.zeros(0), np.zeros(0)
            at.update(zip(new, range(len(at), len(at) + len(new))))
            score = np.concatenate([score, lattice.scores([marked(x) for x in new]) / math.log(10) + go])
            c = np.concatenate([c, np.array([head.get(x, 0) for x in new], float)])

        def chunk(ids, docs):
            seen = set().union(*docs)
            new = [x for x in seen if x not in at]
            if len(at) + len(new) > CACHE:
                new = list(seen)
            learn(new)
            out = []
            for doc, w in zip(ids, docs):
                i = np.fromiter(map(at.__getitem__, w), np.int64, len(w))
                known = c[i] > 0
                rare = Counter([x for x, k in zip(w, known.tolist()) if not k])
                out.append((doc, len(w) + 1, float(np.log10(c[i][known] + 1).sum()) + math.log10(ends + 1), int(known.sum()) + (ends > 0), float(score[i].sum()) + stop, [{"word": x, "k": k} for x, k in rare.items()]))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

        ids, docs, n = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids.append(doc)
                docs.append(words(raw.as_py()))
                n += len(docs[-1]) + 1
                if n >= CHUNK_TOKENS // 4:
                    yield chunk(ids, docs)
                    ids, docs, n = [], [], 0
        if docs:
            yield chunk(ids, docs)

    return run


def lm_scoring(docs: DataFrame, vocabulary: str = VOCABULARY, held_out_of: int = 7, held_out: int = 2, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs (doc_id, text)."""
    pieces, log_weights = read_vocabulary(vocabulary)
    out = fold("doc_id", held_out_of) == held_out
    train = docs.where(~out)
    counts = stored(word_counts(train), "counts")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary_size = total + ends, distinct + (ends > 0)
    logs = fit(counts, pieces, log_weights)
    top = {bytes(w): n for w, n in counts.orderBy(F.desc("n"), "word").limit(head).toLocalIterator()}
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(_score(pieces, logs, top, ends, tokens), SCORED)
    scored = stored(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    joined = scored.select("uid", F.inline("rare")).join(counts, "word")
    k = F.col("k")
    more = joined.groupBy("uid").agg(F.sum(k * F.log10(F.col("n") + 1)).alias("more_log"), F.sum(k).alias("more_known"))
    base = F.col("log_c") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + vocabulary_size + 1))
    rows = scored.drop("rare").join(more, "uid", "left")
    return rows.select("doc_id", out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
