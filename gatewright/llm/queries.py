"""The registered query of each training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import LOWER, UPPER, documents
from .decontamination import decontamination
from .exact_dedup import exact_dedup
from .language_id import language_id
from .line_dedup import line_dedup
from .lm_scoring import lm_scoring
from .mixing import mix
from .ngram_join import ngram_join
from .pii import pii
from .ranked_search import ranked_search
from .secret_scans import secret_scans
from .sharding import SHARDS, SLOTS, lookup_table, place
from .substring_dedup import substring_dedup


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(documents(spark, sf_dir).select("doc_id", "text"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans(documents(spark, sf_dir).select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir).select("doc_id"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("uid")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir).select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_lm_scoring, op2_secret_scans, op3_sharding, op4_decontamination, op5_language_id, op6_ngram_jaccard_join, op7_source_mixing, op8_exact_dedup, op9_pii, op10_substring_dedup, op11_collocations, op12_line_dedup, op13_ranked_search)
    return {f.__name__: f for f in every}


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def oracle_sql() -> dict[str, str]:
    slots = ", ".join(f"({i}, '{s}')" for i, s in enumerate(lookup_table(SHARDS, SLOTS)))
    terms = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    item_words = r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return {
        "op3_sharding": f"""
            WITH slots(slot, shard) AS (VALUES {slots}),
            d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
            SELECT d.doc_id, d.slot, slots.shard FROM d JOIN slots ON d.slot = slots.slot""",
        "op4_decontamination": f"""
            WITH d AS (SELECT doc_id, {item_words % _low("text")} AS w FROM documents),
            b AS (SELECT item_id, {item_words % _low("text")} AS w FROM benchmark),
            pats AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i + 12], ' ') AS p, least(len(w), 13) AS k
                     FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
            ks AS (SELECT DISTINCT k FROM pats),
            wins AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
                     FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
            occ AS (SELECT wins.doc_id, wins.i, wins.k, pats.item FROM wins JOIN pats ON wins.p = pats.p AND wins.k = pats.k),
            hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM occ) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
                   sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
            FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
        "op6_ngram_jaccard_join": rf"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT t FROM s GROUP BY t HAVING count(*) > 1),
            c AS (SELECT s.doc_id, s.t FROM s JOIN common ON s.t = common.t),
            pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM c a JOIN c b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
            links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
            e AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
            reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
            label AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
            SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(label.v, w.doc_id)) AS component_id
            FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN label ON label.u = w.doc_id""",
        "op8_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_low("text")} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
        "op11_collocations": rf"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_low("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
            f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
            f2 AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w)) GROUP BY lang, x, y HAVING count(*) >= 10),
            f3 AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)) GROUP BY lang, x, y, z HAVING count(*) >= 10),
            covers AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y),
            cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, p.f AS l, q.f AS r
                     FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y LEFT JOIN covers c ON c.lang = f2.lang AND c.x = f2.x AND c.y = f2.y
                     WHERE c.longer IS NULL OR 100 * c.longer < 50 * f2.f
                     UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, p.f, q.f FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
                     UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, p.f, q.f FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
            s AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
            low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
            SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000""",
        "op12_line_dedup": rf"""
            WITH k AS (SELECT doc_id, i, line, {_low("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} AS key
                       FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
            h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            j AS (SELECT doc_id, i, line, coalesce(doc_id <> top, FALSE) AS dropped FROM k LEFT JOIN h ON k.key = h.key)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
            FROM j GROUP BY doc_id""",
        "op13_ranked_search": rf"""
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_low("text")}, '{terms}')) AS w FROM documents),
            lengths AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
            g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
            tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w),
            q AS (SELECT item_id, unnest(regexp_extract_all({_low("text")}, '{terms}')) AS w FROM benchmark),
            wt AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM tf GROUP BY w), g),
            qw AS (SELECT item_id, q.w, count(*) * any_value(weight) AS weight FROM q JOIN wt ON q.w = wt.w GROUP BY item_id, q.w),
            s AS (SELECT item_id, tf.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
                  FROM qw JOIN tf ON qw.w = tf.w JOIN lengths ON lengths.doc_id = tf.doc_id CROSS JOIN g GROUP BY item_id, tf.doc_id)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    }
