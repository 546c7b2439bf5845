"""Collocations, line dedup and ranked search against brute force, on tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gatewright.llm import collocations, line_dedup, ranked_search

FIELDS = "doc_id long, text string, lang string, word string, f long, range long, row string, item int, keep string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "\t\n\x0b\x0c\r "


def texts():
    r = random.Random(3)
    word = lambda: r.choice(["the", "of", "New", "york", "city", "São", "paulo", "ab", "cd", "x1", "漢字", "to", "be"])
    line = lambda: " ".join(word() for _ in range(r.randint(1, 9))) + r.choice([".", ",", "", "!", "\x1c"])
    common = ["A line that many documents hold", "a LINE that many documents hold \t", "é" * 19, "é" * 20, "New York City is far. New York City", "x" * 20]
    out = [None, "", " ", "\n\n", "...!?", "the " * 9000, "long line " * 4000 + "\nend", "\n".join(["A line that many documents hold"] * 300)]
    return out + ["\n".join(r.choice([line, lambda: r.choice(common)])() for _ in range(r.randint(1, 12))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate(texts())]
    rows += [rows[9]] * 4 + [(None, rows[12][1], None), (None, rows[13][1], "en"), (None, None, None), (20, rows[30][1], "en"), (20, None, "en")]
    return spark.createDataFrame([(*x, "w", 1, 2, "r", 3, "k") for x in rows], FIELDS).repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, "New York city city"), (2, "the OF to be"), (3, None), (4, "?! -"), (5, "São Paulo 漢字 nowhere"), (5, "x1"), (None, "ab cd"), (7, "nowhere at all")]
    return spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, doc_id long, score long")


def rows_of(docs):
    return [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]


def brute_lines(rows):
    key = lambda x: x.strip(SPACE).translate(LOW)
    holders = defaultdict(set)
    for d, t, _ in rows:
        for x in t.split("\n"):
            holders[key(x)].add(d)
    top = {k: max(d for d in s if d is not None) for k, s in holders.items() if len(k) >= 20 and len(s) >= 3}
    out = Counter()
    for d, t, _ in rows:
        lines = t.split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == d]
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("ranges", [None, 1, 3, 30])
def test_line_dedup(docs, ranges):
    got = Counter(map(tuple, line_dedup.line_dedup(docs, ranges).collect()))
    assert got == brute_lines(rows_of(docs)) and sum(x[2] for x in got) > 300


def test_line_that_all_hold_is_cut_over_ranges(spark):
    rows = [(i, f"this line stands in all documents\nown {i}", "en") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(map(tuple, line_dedup.line_dedup(df, 20).collect())) == brute_lines(rows)
    bitmaps = line_dedup.keep_bitmaps(df, 20).collect()
    assert {r.doc_id for r in bitmaps} == set(range(499)) and {(r.n_lines, r.n_dropped) for r in bitmaps} == {(2, 1)}
    assert line_dedup.kept_lines(b"a\nb", bitmaps[0].keep) == [b"b"]


def test_deduplicated_texts(spark):
    line = "twenty or more code points"
    df = spark.createDataFrame([(1, f"{line}\na"), (2, line), (3, f"b\n{line}\n{line}"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == {1: "a", 2: "", 3: f"b\n{line}\n{line}", 4: ""}


def range_marks(rows, cuts, batch):
    """What ranges, read in batches of some rows, decide; rows: (key, doc, pos), in order."""
    marks = []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        state = line_dedup.Range()
        for at in range(lo, hi, batch):
            some = rows[at : min(hi, at + batch)]
            columns = {c: np.array([x[i] for x in some], np.int64) for c, i in (("high", 0), ("doc_id", 1), ("pos", 2))}
            same = {c: np.zeros(len(some), np.int64) for c in ("low", "text_hash", "n_lines")}
            marks += list(state.read(columns | same | {"null": np.zeros(len(some), bool)}))
        marks += list(state.close())
    by = defaultdict(list)
    for m in marks:
        for k, d, p, s in zip(*(m[c].tolist() for c in ("high", "doc_id", "pos", "state"))):
            by[s].append((k, d, p))
    holders = defaultdict(set)
    for k, d, _ in by[line_dedup.HOLDER]:
        holders[k].add(d)
    return sorted(by[line_dedup.GONE] + [x for x in by[line_dedup.OPEN] if len(holders[x[0]]) >= 3 and x[1] != max(holders[x[0]])])


def test_ranges_in_batches_of_any_size():
    r = random.Random(2)
    for _ in range(300):
        rows = sorted({(r.randint(0, 3), -r.randint(0, 5), r.randint(0, 3)) for _ in range(r.randint(1, 30))})
        rows = [(k, -d, p) for k, d, p in rows]
        docs = {k: {d for x, d, _ in g} for k, g in ((k, list(g)) for k, g in groupby(rows, key=lambda x: x[0]))}
        want = sorted(x for x in rows if len(docs[x[0]]) >= 3 and x[1] != max(docs[x[0]]))
        cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), r.randint(0, 3))))
        assert range_marks(rows, cuts, r.randint(1, 7)) == want


def brute_phrases(rows):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", t.translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if a < 10 or len(p) < 2:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= 10 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in own.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:2000], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("per_part", "chunk"), [(collocations.FRAGMENTS_PER_PART, collocations.CHUNK_WORDS), (1500, 50), (4000, 3)])
def test_collocations(docs, per_part, chunk):
    got = sorted(map(tuple, collocations.collocations(docs, per_part=per_part, chunk_words=chunk).collect()))
    assert got == brute_phrases(rows_of(docs)) and len(got) > 25


def test_counts_pass_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a", "b", None, 10**13), ("en", "c", "d", None, 4 * 10**12)], collocations.PHRASE.replace(", partial boolean", ""))
    words = spark.createDataFrame([("en", "a", 10**13), ("en", "b", 3 * 10**13), ("en", "c", 4 * 10**12 + 1), ("en", "d", 4 * 10**12)], "lang string, word string, f long")
    assert {r.phrase: r.score for r in collocations.scored(phrases, words).collect()} == {"a b": 333_333, "c d": 999_999}


def test_partial_counts_where_numbers_run_out():
    counts = collocations.Counts()
    row = {"langs": ["en", ""], "lang_of": np.array([1, 0, 0], np.uint32).tobytes(), "words": [b"!", b"a", b"b"], "times": np.array([4], np.uint32).tobytes(), "dealt": b"\0"}
    row["numbers"] = zstandard.compress(np.array([[0], [1], [2], [1], [0]], np.uint16).tobytes())
    seen = Counter()
    for last in (False, False, True):
        counts.add(row)
        for batch in counts.rows(last):
            for r in batch.to_pylist():
                assert r["partial"]
                seen[(r["w1"], r["w2"], r["w3"])] += r["f"]
    assert seen == {("a", "b", None): 12, ("b", "a", None): 12, ("a", "b", "a"): 12}


def test_every_phrase_has_one_owner():
    r = random.Random(4)
    for _ in range(200):
        text = np.array([r.randint(0, 5) for _ in range(r.randint(1, 25))], np.int32)
        place = np.array([-1, *r.sample(range(5), 5)])
        table, times = collocations.fragments(text, np.ones(len(text), bool), place)
        got = Counter()
        for (l2, l1, p, r1, r2), n in zip(table.tolist(), times.tolist()):
            for phrase in ((l1, p), (p, r1), (l2, l1, p), (l1, p, r1), (p, r1, r2)):
                if all(phrase):
                    assert p == min(phrase, key=lambda x: place[x])
                    got[phrase] += n
        want = Counter(tuple(text[i : i + k].tolist()) for k in (2, 3) for i in range(len(text) - k + 1))
        assert got == {p: n for p, n in want.items() if all(p)}


def brute_search(rows, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(d, Counter(terms(t))) for d, t, _ in rows]
    held = [(d, c, c.total()) for d, c in held if c]
    total, df = sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out[(item, rank, d, -score)] += 1
    return out


@pytest.mark.parametrize("words", [ranked_search.MAX_BLOCK_WORDS, 4])
def test_ranked_search(docs, benchmark, words):
    got = Counter(map(tuple, ranked_search.ranked_search(docs, benchmark, max_block_words=words).collect()))
    assert got == brute_search(rows_of(docs), [(r.item_id, r.text) for r in benchmark.collect()]) and len(got) > 60


def test_ties_are_opened_and_most_nodes_are_not(spark):
    r = random.Random(8)
    block = ranked_search.Block([(0, b"a b c")])
    n = block.span
    counts = [(p, t) for p in range(n) for t in range(3) if r.random() < 0.02] + [(p, t) for p in (17, 900, 901, 3000) for t in range(3)]
    counts = sorted(set(counts))
    block.weigh(n, 10 * n, Counter(t for _, t in counts))
    place, term = (np.array(x) for x in zip(*counts))
    trees = ranked_search.MaxTrees(block, place, np.full(len(place), 10), term, np.ones(len(place), np.int64))
    rows, weights = block.queries[0]
    scores = weights @ trees.levels[-1][rows]
    found, opened = trees.best(rows, weights, 2, 0)
    assert sorted(found) == sorted((int(s), p) for p, s in enumerate(scores) if s == scores.max()) and len(found) >= 4
    assert opened < 60  # of 273
    assert trees.best(rows, weights, 2, int(scores.max()) + 1)[0] == []


def test_equal_scores_go_by_document(spark):
    df = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)], "doc_id long, text string").repartition(5)
    df = df.unionByName(spark.createDataFrame([(i, "other text") for i in range(301, 500)], "doc_id long, text string"))
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [r.doc_id for r in ranked_search.ranked_search(df, items).orderBy("rank").collect()] == list(range(1, 21))


def test_empty_tables(spark, docs, benchmark):
    none = docs.limit(0)
    assert line_dedup.line_dedup(none).isEmpty() and collocations.collocations(none).isEmpty()
    assert ranked_search.ranked_search(none, benchmark).isEmpty() and ranked_search.ranked_search(docs, benchmark.limit(0)).isEmpty()
    assert collocations.collocations(docs.where(F.col("text").isNull())).isEmpty()
