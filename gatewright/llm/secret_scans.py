"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its bytes. The ledger holds which blob has been
scanned by which version of which rule, with the findings; only unseen pairs are scanned, once however many paths
carry the blob, and findings are joined back to all paths.

Positions come from the pieces between matches: their lengths and the matches' lengths, added up in order.

A scan appends its findings first and then the pairs that it has scanned. A scan that is lost in between is done again, and
its findings count once: they are read as a set, so the ledger is right after any crash.

Defined results: a null text counts as empty and has no findings; repeated rows are each returned; a null path is a
path like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, stored


@dataclass(frozen=True)
class Rule:
    """A finding is a match whose group is at least least characters long. order: among findings of one start."""

    kind: str
    pattern: str
    group: int
    least: int
    order: int
    version: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, 0),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, 1),  # as AKIA[A-Z0-9]+ of 16 or more: the first AKIA of a run has its longest match
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, 2),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, 3, base=False),
)


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("blob"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of blobs (blob, text, rules: array of kind:version to apply): blob, kind, version, start, end."""
    t = F.col("text")

    def one(r: Rule):
        hit = F.array_contains("rules", f"{r.kind}:{r.version}") & t.rlike(r.pattern)
        gaps = F.transform(F.split(t, r.pattern, -1), F.length)
        spans = F.transform(F.regexp_extract_all(t, F.lit(r.pattern), 0), F.length)
        kept = F.transform(F.regexp_extract_all(t, F.lit(r.pattern), r.group), F.length)
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(hit, F.arrays_zip(gaps.alias("gap"), spans.alias("len"), kept.alias("part"))).alias("m"))

    each = blobs.select("blob", F.explode(F.array(*map(one, rules))).alias("r")).where("r.m is not null")
    rows = each.select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.m").alias("pos", "m")).where("m.len is not null")
    so_far = Window.partitionBy("blob", "kind", "version").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)
    return rows.select("blob", "kind", "version", (end - F.col("m.len")).alias("start"), end.alias("end"), (F.col("m.part") >= F.col("least")).alias("ok")).where("ok").drop("ok")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger has not seen, add it to the ledger, and return the versions (path, blob) of docs.

    The ledger folder holds scanned (blob, kind, version) and findings (blob, kind, version, start, end)."""
    spark = docs.sparkSession
    seen = _table(spark, f"{ledger}/scanned", "blob binary, kind string, version int")
    new = stored(versions(docs, path, text), "versions")
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    blobs = new.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.select("blob", "path", F.explode(wanted).alias("w")).select("blob", "path", "w.kind", "w.version").join(seen, ["blob", "kind", "version"], "left_anti")
    todo = stored(pairs.groupBy("blob", "path").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("rules")), "unseen")
    texts = docs.select(F.col(path).alias("of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A blob is read from one of its paths only; a path with several versions is told apart by the address.
    picked = texts.join(todo, F.col("of").eqNullSafe(F.col("path"))).where(F.col("blob") == F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    scan(picked, rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.explode("rules").alias("r")).select("blob", F.split_part("r", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("r", F.lit(":"), F.lit(2)).cast("int").alias("version")).write.mode("append").parquet(f"{ledger}/scanned")
    return new


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What the ledger holds for these rules' versions; once each, also where a lost scan was written twice."""
    known = _table(spark, f"{ledger}/findings", "blob binary, kind string, version int, start long, end long").distinct()
    return known.where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))


def secret_scans(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    paths = update_ledger(docs, ledger, rules)
    order = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.order)])
    each = F.struct("start", order[F.col("kind")].alias("o"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    digests = findings(spark, ledger, rules).groupBy("blob").agg(*counts, joined(F.collect_list(F.when(base, each))).alias("b"), joined(F.collect_list(each)).alias("spans"))
    found = stored(digests.select("blob", "n_assign", "n_access", "n_hex", F.sha2(F.col("b").cast("binary"), 256).alias("base_sha256"), "spans"), "digests")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    rows = paths.join(found, "blob", "left")
    return rows.select(F.col("path").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.coalesce("base_sha256", nothing).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
