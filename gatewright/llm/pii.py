"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans (e-mail, ip, card, phone), in time linear in the text. The field labels a document's tokens that hold a digit, an at
sign or a spelled one, as (at) or [dot]; all other tokens are outside. A token's potentials come from its shape, the shapes next to it and the words before and after it;
none tests a pattern. Neighbouring tokens share chain potentials. Tokens that are equal, or similar (the same letters
and digits, the same last 7 of at least 7 digits, or the same mail name), share skip potentials however far apart they
are: each occurrence is linked with the one before it and with the first, so a label spreads over any number of hops.
Damped loopy sum-product makes labels consistent across the document; base spans are its evidence. A token whose label has a marginal of
at least min_marginal and that overlaps no base span adds a span, whether or not the document has base spans; added tokens
of one label that stand next to each other are one span. Base spans always stay.

The field is trained here. Rows are a sample by a hash of id and text, of about TRAIN_ROWS rows in all; all tokens of their whole texts give the
counts of label pairs, and about TRAIN_TOKENS of these tokens, by hash again, the softmax regression of token potentials (both bounds are
parameters). Base spans label the tokens. Each sampled text is also read with its base spans disguised (at signs and dots spelled out, separators
changed, plus signs left out), and the disguised tokens keep the label: so the field learns what patterns cannot match. Unlabelled tokens that repeat a labelled
one teach nothing. Chain and skip potentials are log ratios of label pairs to independence (piecewise training).
Prediction reads all rows and whole texts.

Defined results: a null text counts as empty: no spans; repeated rows are each returned; null doc_ids are returned as
they are; without training tokens only base spans are found; an empty table gives no rows; other columns are ignored; very long texts are
one document like any other. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
NAME = "A-Za-z0-9._%+-"
#: A match begins where a run of its first characters does: what begins within the run is no match that the run's begin is not.
EMAIL_HERE = re.compile(rf"[{NAME}]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL = re.compile(rf"(?<![{NAME}])" + EMAIL_HERE.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = r"[(\[{<](?:at|dot|\.)[)\]}>]"
SIGN = re.compile(rf"[0-9@]|{SPELLED}", re.IGNORECASE)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\W\d_]+")
TRAIN_ROWS, TRAIN_TOKENS, MIN_MARGINAL, STEPS, DAMP = 4000, 20_000, 0.9, 25, 0.3
FEATURES, SURE = 512, 12.0
#: Tokens with no more than this between them are neighbours; words without a sign may stand between.
NEIGHBOUR_GAP = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _emails(text: str):
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    if SIGN.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _ip_ok(m[0])]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a sign: runs of other than white space, without punctuation around them."""
    out, at = [], 0
    while m := SIGN.search(text, at):
        lo = m.start()
        while lo > at and not text[lo - 1] in " \t\n\x0b\x0c\r":
            lo -= 1
        run = TOKEN.match(text, m.start())
        hi = at = run.end()
        while hi > lo and not text[hi - 1].isalnum():
            hi -= 1
        while lo < hi and not (text[lo].isalnum() or text[lo] in "+("):
            lo += 1
        if lo < hi:
            out.append((lo, hi))
    return out


def shape(t: str) -> str:
    """Letters as a, digits as 9, repeats as one, as far as 24 characters of that."""
    out = ""
    for c in t:
        c = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out.endswith(c):
            out += c
            if len(out) == 24:
                break
    return out


def features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Feature numbers of each token."""
    shapes = [shape(text[lo:hi]) for lo, hi in spans]
    out = []
    for i, (lo, hi) in enumerate(spans):
        n = len(_digits(text[lo:hi]))
        names = ["bias", f"shape {shapes[i]}", f"digits {np.searchsorted([1, 4, 7, 10, 11, 13, 20], n, 'right')}"]
        names += [f"before {w.lower()}" for w in WORD.findall(text[max(0, lo - NEIGHBOUR_GAP) : lo])[-2:]]
        names += [f"after {w.lower()}" for w in WORD.findall(text[hi : hi + NEIGHBOUR_GAP])[:1]]
        names += [f"left {text[lo - 1 : lo]}", f"signs {''.join(sorted(set(shapes[i])))}"]
        names += [f"spelled {m.lower()}" for m in set(re.findall(SPELLED, text[lo:hi], re.IGNORECASE))] + ["at"] * ("@" in text[lo:hi])
        if i and lo - spans[i - 1][1] <= 3:
            names.append(f"previous {shapes[i - 1]}")
        if i + 1 < len(spans) and spans[i + 1][0] - hi <= 3:
            names.append(f"next {shapes[i + 1]}")
        out.append([_number(x) for x in names])
    return out


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % FEATURES


def _forms(t: str) -> list[str]:
    form = "".join(filter(str.isalnum, t.lower()))
    d = _digits(t)
    mail = t.partition("@")
    return ["=" + form] + ["#" + d[-7:]] * (len(d) >= 7) + ["@" + mail[0].lower()] * (len(mail[0]) >= 3 and mail[1] == "@")


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of neighbours and skip edges of equal or similar tokens; two that are both have both potentials."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= NEIGHBOUR_GAP]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = set()
    for i, (lo, hi) in enumerate(spans):
        for f in _forms(text[lo:hi]):
            if f in first:
                skip |= {(first[f], i), (last[f], i)}
            first.setdefault(f, i)
            last[f] = i
    return chain, sorted(skip)


def repeats(skip: list[tuple[int, int]], y: np.ndarray) -> np.ndarray:
    """Whether an unlabelled token is linked by skip edges, directly or not, with a labelled one."""
    root = list(range(len(y)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in skip:
        root[top(i)] = top(j)
    labelled = {top(int(i)) for i in np.flatnonzero(y)}
    return np.array([not y[i] and top(i) in labelled for i in range(len(y))], bool)


def labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """0: outside; 1 and up: kinds, of tokens that overlap a base span."""
    out = np.zeros(len(spans), np.int64)
    ends = np.array([hi for _, hi in spans], np.int64)
    for kind, lo, hi in reversed(base):
        i = int(np.searchsorted(ends, lo, "right"))
        while i < len(spans) and spans[i][0] < hi:
            out[i] = kind + 1
            i += 1
    return out


@dataclass
class Field:
    token: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, x: list[list[int]]) -> np.ndarray:
        return np.array([self.token[f].sum(axis=0) for f in x]).reshape(len(x), self.token.shape[1])

    def marginals(self, unary: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], steps: int = STEPS, damp: float = DAMP) -> np.ndarray:
        e = np.array(chain + skip, np.int64).reshape(-1, 2)
        if not len(e):
            return _softmax(unary)
        # A message for each direction of an edge, from e[:, 0] to e[:, 1].
        pot = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
        a, b = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        m = np.zeros((len(a), unary.shape[1]))
        for _ in range(steps):
            belief = unary.copy()
            np.add.at(belief, b, m)
            out = (belief[a] - m[back])[:, :, None] + pot
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - m).max()
            m = damp * m + (1 - damp) * new
            if moved < 1e-4:
                break
        belief = unary.copy()
        np.add.at(belief, b, m)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def coupling(counts: dict[tuple[int, int], int], same: float) -> np.ndarray:
    """log of label pairs' frequencies over independence, smoothed towards agreement by so many pairs."""
    size = len(KINDS) + 1
    n = np.full((size, size), 0.1) + same * np.eye(size)
    for (i, j), k in counts.items():
        n[i, j] += k
        n[j, i] += k
    p = n / n.sum()
    return np.clip(np.log(p) - np.log(p.sum(1))[:, None] - np.log(p.sum(0))[None], -6, 6)


def disguised(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its base spans written as no pattern matches them, and where these are."""
    out, spans, at, size = [], [], 0, 0
    for k, lo, hi in sorted(base, key=lambda s: (s[1], -s[2])):
        if lo < at:
            continue
        t = text[lo:hi]
        chance = zlib.crc32(t.encode("utf-8", "replace"))
        even = chance % 2 == 0
        if KINDS[k] == "email":
            t = t.replace("@", "(at)" if even else "[at]")
            t = t.replace(".", "(dot)") if chance % 3 == 0 else t
        elif KINDS[k] == "ip":
            t = t.replace(".", "[.]" if even else "(.)")
        elif KINDS[k] == "card":
            t = re.sub(r"[\x20-]", "." if even else "_", t)
            t = re.sub(r"([0-9]{4})(?=[0-9])", r"\1." if even else r"\1_", t) if t.isdigit() else t
        else:
            t = t[1:]
        out += [text[at:lo], t]
        size += lo - at
        spans.append((k, size, size + len(t)))
        size += len(t)
        at = hi
    return "".join([*out, text[at:]]), spans


def examples(text: str):
    """(features, label) of tokens, and (edge kind, label, label) of edges, of the text and of its disguised form."""
    base = base_spans(text)
    for t, found in [(text, base), disguised(text, base)][: 1 + bool(base)]:
        spans = tokens(t)
        if spans:
            y = labels(spans, found)
            chain, skip = edges(t, spans)
            silent = repeats(skip, y)
            yield [(x, int(k)) for x, k, s in zip(features(t, spans), y, silent) if not s], [(name, int(y[i]), int(y[j])) for name, es in (("chain", chain), ("skip", skip)) for i, j in es if not (silent[i] or silent[j])]


def train(tokens_: list[tuple[list[int], int, float]], pairs: dict[str, dict[tuple[int, int], int]]) -> Field | None:
    """The field from (features, label, number of such tokens) and counts of label pairs by kind of edge.

    Labels weigh the same in the regression; their shares come back as potentials of every token."""
    if not tokens_:
        return None
    size = len(KINDS) + 1
    x = np.zeros((len(tokens_), FEATURES), np.float32)
    for i, (f, _, _) in enumerate(tokens_):
        np.add.at(x[i], f, 1)
    k, n = np.array([k for _, k, _ in tokens_]), np.array([n for _, _, n in tokens_], float)
    y = np.eye(size, dtype=np.float32)[k]
    total = np.bincount(k, n, size)
    weight = (n / total[k] / np.count_nonzero(total)).astype(np.float32)[:, None]
    w, seen = np.zeros((2, FEATURES, size), np.float32)
    for _ in range(600):  # steps scaled by each weight's gradients so far, for rare features learn as fast as common ones
        g = x.T @ (weight * (_softmax(x @ w) - y)) + 1e-5 * w
        seen += g * g
        w -= 0.2 * g / (np.sqrt(seen) + 1e-8)
    w = w.astype(float)
    w[_number("bias")] += np.log((total + 0.1) / total.sum())
    return Field(w, coupling(pairs.get("chain", {}), 2.0), coupling(pairs.get("skip", {}), 20.0))


def find(text: str, field: Field | None, min_marginal: float = MIN_MARGINAL) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the field adds."""
    base = base_spans(text)
    spans = tokens(text) if field is not None else []
    if not spans:
        return base, []
    y = labels(spans, base)
    unary = field.unary(features(text, spans))
    known = np.flatnonzero(y)
    unary[known, y[known]] += SURE
    p = field.marginals(unary, *edges(text, spans))
    out: list[tuple[int, int, int]] = []
    for i, (lo, hi) in enumerate(spans):
        k = int(p[i].argmax())
        if k and not y[i] and p[i, k] >= min_marginal:
            if out and i and not y[i - 1] and out[-1][0] == k - 1 and out[-1][2] == spans[i - 1][1] and lo - out[-1][2] <= 2:
                out[-1] = (k - 1, out[-1][1], hi)
            else:
                out.append((k - 1, lo, hi))
    return base, out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _scan(field: Field | None, min_marginal: float):
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for t in batch["text"]:
                text = t.as_py()
                base, added = find(text, field, min_marginal) if text and SIGN.search(text) else ([], [])
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest() if base else nothing)
                spans.append(_join(base + added))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    return run


def _examples(batches):
    """A row for each token (its features and label) and, by batch, for each kind of edge and pair of labels their number."""
    names, schema = ("x", "edge", "i", "j", "n"), (pa.list_(pa.int32()), pa.string(), pa.int32(), pa.int32(), pa.int64())
    for batch in batches:
        rows, pairs = [], {}
        for t in batch["text"]:
            for found, linked in examples(t.as_py()):
                rows += [(x, None, k, None, 1) for x, k in found]
                for e in linked:
                    pairs[e] = pairs.get(e, 0) + 1
        rows += [(None, *e, n) for e, n in pairs.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema)], names=names)


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, tokens_: int = TRAIN_TOKENS) -> Field | None:
    """The field, from about rows rows that hold a sign and about tokens_ of their tokens, both by hash."""
    seen = docs.where(F.col("text").rlike(f"(?i){SIGN.pattern}"))
    n = seen.count()
    h = F.xxhash64(F.lit("pii"), F.col("doc_id").cast("string"), "text")
    few = seen.where(F.pmod(h, F.lit(1_000_000)) < 1_000_000 * min(1.0, rows / max(n, 1))).select("text")
    made = stored(few.mapInArrow(_examples, "x array<int>, edge string, i int, j int, n long"), "examples")
    pairs: dict[str, dict[tuple[int, int], int]] = {}
    for r in made.where("edge is not null").groupBy("edge", "i", "j").agg(F.sum("n").alias("n")).collect():
        pairs.setdefault(r["edge"], {})[(r["i"], r["j"])] = r["n"]
    distinct = stored(made.where("x is not null").groupBy("x", "i").agg(F.count("*").alias("n")), "tokens")
    kinds = {r["i"]: r["d"] for r in distinct.groupBy("i").agg(F.count("*").alias("d")).collect()}
    if not kinds:
        return None
    share = {k: min(1.0, tokens_ / len(kinds) / d) for k, d in kinds.items()}
    rate = F.create_map(*[F.lit(v) for k, s in share.items() for v in (k, s)])[F.col("i")]
    picked = distinct.where(F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < rate * 1_000_000)
    return train(sorted((list(r["x"]), r["i"], r["n"] / share[r["i"]]) for r in picked.toLocalIterator()), pairs)


def pii(docs: DataFrame, field: Field | None = None, min_marginal: float = MIN_MARGINAL) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row of docs (doc_id, text)."""
    field = field or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(field, min_marginal), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
