"""Registered queries of the gates, reports, metrics and transforms, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_slug, slug
from ..operators import diversity, faults, gates
from ..operators.schema_gate import schema_gate
from ..sources.views import TABLE_COMPAT, Views, from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PRELUDE = """
artifact AS (SELECT o_orderkey AS quest_id, o_orderpriority AS quest_type, 'cust_' || o_custkey AS giver, 'nation_' || (o_custkey % 27) AS start, o_orderkey % 3 AS set_id, o_orderkey AS ord FROM orders),
objective AS (SELECT l_orderkey AS quest_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, CAST(l_linenumber AS BIGINT) AS step_no, l_returnflag || l_linestatus AS action, 'part_' || l_partkey AS target, l_suppkey % 8 AS dep_no FROM lineitem),
reward AS (SELECT o_orderkey AS quest_id, 0 AS pos, CASE WHEN o_orderstatus = 'F' THEN 'item' ELSE 'currency' END AS type, CASE WHEN o_orderkey % 7 = 0 THEN 'cust_' || o_custkey ELSE 'part_' || (o_orderkey % 2500) END AS value FROM orders),
entity AS (SELECT 'part_' || p_partkey AS entity_id, lower(p_type) AS entity_type FROM part WHERE p_size <= 45 UNION ALL SELECT 'cust_' || c_custkey, 'customer' FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'nation_' || n_nationkey, 'nation' FROM nation),
compat AS (SELECT * FROM (VALUES @COMPAT) t(action, entity_type)),
sigs AS (SELECT a.quest_id, a.ord, coalesce(s.signature, '') AS signature FROM artifact a LEFT JOIN (SELECT o.quest_id, string_agg(lower(o.action) || ':' || coalesce(e.entity_type, 'unknown'), ' -> ' ORDER BY o.pos) AS signature FROM objective o LEFT JOIN entity e ON o.target = e.entity_id GROUP BY o.quest_id) s ON a.quest_id = s.quest_id),
refs AS (SELECT r.quest_id, r.ref FROM (SELECT quest_id, giver AS ref FROM artifact UNION ALL SELECT quest_id, start FROM artifact UNION ALL SELECT quest_id, target FROM objective UNION ALL SELECT quest_id, value FROM reward WHERE type = 'item') r JOIN entity e ON r.ref = e.entity_id),
wanted AS (SELECT quest_id, 'giver_npc' AS path, giver AS ref, 'UNKNOWN' AS w FROM artifact),
edges AS (SELECT DISTINCT quest_id, dep_no AS src, step_no AS dst FROM objective WHERE dep_no <> 0),
nodes AS (SELECT quest_id, step_no AS node FROM objective UNION SELECT quest_id, src FROM edges),
reach(quest_id, src, dst, d) AS (SELECT quest_id, src, dst, 1 FROM edges UNION SELECT r.quest_id, r.src, e.dst, r.d + 1 FROM reach r JOIN edges e ON r.quest_id = e.quest_id AND r.dst = e.src WHERE r.d < 8),
cyclic AS (SELECT DISTINCT quest_id FROM reach WHERE src = dst),
roots AS (SELECT n.quest_id, n.node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.quest_id = n.quest_id AND e.dst = n.node) AND n.quest_id NOT IN (SELECT quest_id FROM cyclic)),
ends AS (SELECT n.quest_id, n.node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.quest_id = n.quest_id AND e.src = n.node) AND n.quest_id NOT IN (SELECT quest_id FROM cyclic)),
missing AS (SELECT o.quest_id, o.pos, o.dep_no FROM objective o WHERE o.dep_no <> 0 AND NOT EXISTS (SELECT 1 FROM objective s WHERE s.quest_id = o.quest_id AND s.step_no = o.dep_no)),
ref_issues AS (
  SELECT a.quest_id, CASE WHEN e.entity_id IS NULL THEN 'UNKNOWN_ENTITY' ELSE 'INVALID_QUEST_GIVER_TYPE' END AS code, 'giver_npc' AS path, a.giver AS detail FROM artifact a LEFT JOIN entity e ON a.giver = e.entity_id WHERE e.entity_id IS NULL OR e.entity_type <> 'customer'
  UNION ALL SELECT a.quest_id, CASE WHEN e.entity_id IS NULL THEN 'UNKNOWN_ENTITY' ELSE 'INVALID_START_LOCATION_TYPE' END, 'start_location', a.start FROM artifact a LEFT JOIN entity e ON a.start = e.entity_id WHERE e.entity_id IS NULL OR e.entity_type <> 'nation'
  UNION ALL SELECT r.quest_id, CASE WHEN e.entity_id IS NULL THEN 'UNKNOWN_ENTITY' ELSE 'INVALID_REWARD_ITEM_TYPE' END, 'rewards[' || r.pos || '].value', r.value FROM reward r LEFT JOIN entity e ON r.value = e.entity_id WHERE r.type = 'item' AND (e.entity_id IS NULL OR e.entity_type NOT IN (SELECT entity_type FROM compat))
  UNION ALL SELECT quest_id, 'DUPLICATE_STEP_ID', 'objectives', CAST(step_no AS VARCHAR) FROM objective GROUP BY quest_id, step_no HAVING count(*) > 1
  UNION ALL SELECT o.quest_id, CASE WHEN e.entity_id IS NULL THEN 'INVALID_OR_IMPLICIT_TARGET' ELSE 'INCOMPATIBLE_ACTION_TARGET' END, 'objectives[' || o.pos || '].target', o.target FROM objective o LEFT JOIN entity e ON o.target = e.entity_id WHERE e.entity_id IS NULL OR (o.action IN (SELECT action FROM compat) AND NOT EXISTS (SELECT 1 FROM compat c WHERE c.action = o.action AND c.entity_type = e.entity_type))),
graph_issues AS (
  SELECT quest_id, 'MISSING_STEP_DEPENDENCY' AS code, 'error' AS severity, 'objectives[' || pos || '].depends_on' AS path, CAST(dep_no AS VARCHAR) AS detail FROM missing
  UNION ALL SELECT quest_id, 'CYCLIC_OBJECTIVE_DEPENDENCY', 'error', 'objectives', '' FROM cyclic
  UNION ALL SELECT quest_id, 'MULTIPLE_OBJECTIVE_ROOTS', 'warning', 'objectives', CAST(count(*) AS VARCHAR) FROM roots GROUP BY quest_id HAVING count(*) > 1),
issues AS (SELECT quest_id, 'referential' AS validator, code, 'error' AS severity FROM ref_issues UNION ALL SELECT quest_id, 'graph', code, severity FROM graph_issues),
grid AS (SELECT a.quest_id, v.validator, coalesce(i.errors, 0) AS errors, coalesce(i.warnings, 0) AS warnings, coalesce(i.errors, 0) = 0 AS passed FROM artifact a CROSS JOIN (VALUES ('referential'), ('graph')) v(validator) LEFT JOIN (SELECT quest_id, validator, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM issues GROUP BY quest_id, validator) i ON i.quest_id = a.quest_id AND i.validator = v.validator),
passes AS (SELECT quest_id, bool_and(passed) AS passed, sum(errors) AS errors, sum(warnings) AS warnings FROM grid GROUP BY quest_id)
""".replace("@COMPAT", ", ".join(f"('{a}', '{t}')" for a, ts in TABLE_COMPAT.items() for t in ts))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {PRELUDE} {sql}"
        return f

    return register


def over_views(sql: str | None = None):
    """Register a function of the views."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(from_tables(spark, sf_dir))

        run.__name__ = f.__name__
        query(sql)(run)
        return f

    return register


def table(name: str, sql: str | None = None):
    """Register a function of one table."""

    def register(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        query(sql)(run)
        return f

    return register


def _r(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


# Catalog


@over_views("SELECT entity_type, count(*) AS n, min(entity_id) AS first_id FROM entity GROUP BY entity_type")
def world_catalog(v: Views) -> DataFrame:
    return v.entity.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))


@over_views("SELECT entity_id, count(*) AS n FROM entity GROUP BY entity_id HAVING count(*) > 1")
def world_duplicate_ids(v: Views) -> DataFrame:
    return v.entity.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")


# Referential gate


def _ref(code: str, name: str, extra: str = "TRUE"):
    def run(v: Views) -> DataFrame:
        return gates.referential(v).where(F.col("code") == code).select("quest_id", "path", "detail")

    run.__name__ = name
    over_views(f"SELECT quest_id, path, detail FROM ref_issues WHERE code = '{code}'")(run)


for _code, _name in {"UNKNOWN_ENTITY": "ref_unknown_entity", "INVALID_QUEST_GIVER_TYPE": "ref_giver_type", "INVALID_START_LOCATION_TYPE": "ref_start_type", "INVALID_REWARD_ITEM_TYPE": "ref_reward_type", "DUPLICATE_STEP_ID": "ref_duplicate_step", "INVALID_OR_IMPLICIT_TARGET": "ref_implicit_target", "INCOMPATIBLE_ACTION_TARGET": "ref_incompatible_action"}.items():
    _ref(_code, _name)


@over_views("SELECT code, count(*) AS issues, count(DISTINCT quest_id) AS artifacts FROM ref_issues GROUP BY code")
def ref_gate_summary(v: Views) -> DataFrame:
    return gates.referential(v).groupBy("code").agg(F.count("*").alias("issues"), F.count_distinct("quest_id").alias("artifacts"))


# Graph gate


@over_views("SELECT quest_id, src, dst FROM edges")
def graph_edges(v: Views) -> DataFrame:
    return gates.dependency_edges(v)


@over_views("SELECT DISTINCT quest_id, src, dst FROM (SELECT quest_id, lag(step_no) OVER (PARTITION BY quest_id ORDER BY pos) AS src, step_no AS dst FROM objective) WHERE src IS NOT NULL")
def graph_chain_edges(v: Views) -> DataFrame:
    return gates.chain_edges(v)


@over_views("SELECT quest_id, pos, dep_no FROM missing")
def graph_missing_dep(v: Views) -> DataFrame:
    return gates.missing_dependencies(v)


@over_views("SELECT quest_id FROM cyclic")
def graph_cycles(v: Views) -> DataFrame:
    return gates.graph_facts(v).where("cyclic").select("quest_id")


@over_views("SELECT r.quest_id, r.s AS roots, e.s AS terminals FROM (SELECT quest_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS s FROM roots GROUP BY quest_id) r JOIN (SELECT quest_id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS s FROM ends GROUP BY quest_id) e ON r.quest_id = e.quest_id")
def graph_roots_terminals(v: Views) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return gates.graph_facts(v).where("not cyclic").select("quest_id", text("roots"), text("terminals"))


@over_views("SELECT quest_id, count(*) AS roots FROM roots GROUP BY quest_id HAVING count(*) > 1")
def graph_multi_root(v: Views) -> DataFrame:
    return gates.graph_facts(v).where(F.size("roots") > 1).select("quest_id", F.size("roots").cast("long").alias("roots"))


@over_views("SELECT quest_id, path, detail FROM graph_issues WHERE code = 'UNREACHABLE_OBJECTIVE'")
def graph_unreachable(v: Views) -> DataFrame:
    return gates.graph(v, ("UNREACHABLE_OBJECTIVE",)).select("quest_id", "path", "detail")


@over_views("""SELECT n.quest_id, n.n AS n_nodes, coalesce(e.n, 0) AS n_edges, round(CASE WHEN n.n > 1 THEN CAST(coalesce(e.n, 0) AS DOUBLE) / (n.n * (n.n - 1)) ELSE 0 END, 6) AS density, round(CASE WHEN n.n > 1 THEN CAST(coalesce(d.d, 0) AS DOUBLE) / (n.n - 1) ELSE 0 END, 6) AS max_degree_centrality
    FROM (SELECT quest_id, count(*) AS n FROM nodes GROUP BY quest_id) n LEFT JOIN (SELECT quest_id, count(*) AS n FROM edges GROUP BY quest_id) e ON n.quest_id = e.quest_id
    LEFT JOIN (SELECT quest_id, max(c) AS d FROM (SELECT quest_id, x, count(*) AS c FROM (SELECT quest_id, src AS x FROM edges UNION ALL SELECT quest_id, dst FROM edges) GROUP BY quest_id, x) GROUP BY quest_id) d ON n.quest_id = d.quest_id""")
def graph_metrics(v: Views) -> DataFrame:
    return gates.graph_metrics(v).select("quest_id", "n_nodes", "n_edges", _r("density", "density"), _r("max_degree_centrality", "max_degree_centrality"))


@over_views("""SELECT max_depth, count(*) AS artifacts FROM (SELECT quest_id, max(d) AS max_depth FROM (SELECT quest_id, dst, min(d) AS d FROM (SELECT r.quest_id, r.dst, r.d FROM reach r JOIN roots x ON r.quest_id = x.quest_id AND r.src = x.node UNION ALL SELECT quest_id, node, 0 FROM roots) GROUP BY quest_id, dst) GROUP BY quest_id) GROUP BY max_depth""")
def graph_depths(v: Views) -> DataFrame:
    acyclic = gates.graph_facts(v).where("not cyclic").select("quest_id")
    return gates.graph_metrics(v).join(acyclic, "quest_id", "left_semi").groupBy("max_depth").agg(F.count("*").alias("artifacts"))


@over_views("""SELECT components, count(*) AS artifacts FROM (SELECT quest_id, count(*) AS components FROM (SELECT n.quest_id, n.node, min(coalesce(least(n.node, w.dst), n.node)) AS label FROM nodes n LEFT JOIN (SELECT * FROM weak) w ON w.quest_id = n.quest_id AND w.src = n.node GROUP BY n.quest_id, n.node) WHERE node = label GROUP BY quest_id) GROUP BY components""".replace("(SELECT * FROM weak)", "(SELECT a.quest_id, a.src, a.dst FROM w8 a)"))
def graph_components(v: Views) -> DataFrame:
    return gates.graph_metrics(v).groupBy("components").agg(F.count("*").alias("artifacts"))


SQL["q_graph_components"] = SQL["q_graph_components"].replace(" SELECT components,", ", w8(quest_id, src, dst) AS (SELECT quest_id, src, dst FROM edges UNION SELECT quest_id, dst, src FROM edges UNION SELECT a.quest_id, a.src, e.y FROM w8 a JOIN (SELECT quest_id, src AS x, dst AS y FROM edges UNION SELECT quest_id, dst, src FROM edges) e ON a.quest_id = e.quest_id AND a.dst = e.x) SELECT components,", 1)


# Content gate

GENERIC, WEAK = "(all|the) [a-z]+ (in|and|of) ", "^(the|de|la|der) "


@table("documents", f"SELECT doc_id, len(regexp_extract_all(lower(text), '{GENERIC}')) > 0 AS generic FROM documents WHERE regexp_matches(lower(text), '{GENERIC}')")
def content_generic(d: DataFrame) -> DataFrame:
    return d.where(F.lower("text").rlike(f"(?Ud){GENERIC}")).select("doc_id", F.lit(True).alias("generic"))


@table("documents", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(trim(text)), '{WEAK}')")
def content_weak(d: DataFrame) -> DataFrame:
    return d.where(F.lower(F.trim("text")).rlike(f"(?Ud){WEAK}")).select("doc_id")


@table("documents", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) < 120")
def content_short(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.length(F.trim("text")).cast("long").alias("n")).where("n < 120")


# The general schema gate over VARIANT rows

#: A schema for orders and their lines as JSON.
ORDER_SCHEMA = {"type": "object", "required": ["quest_type", "objectives"], "properties": {"quest_type": {"enum": ["1-URGENT", "2-HIGH"]}, "objectives": {"type": "array", "minItems": 2, "maxItems": 5, "items": {"type": "object", "additionalProperties": False, "properties": {"action": {"type": "string", "pattern": "^[AR]F$"}, "dep": {"type": "integer", "maximum": 5}}}}}}


@over_views("""SELECT quest_id, 'quest_type' AS path, 'enum' AS keyword FROM artifact WHERE quest_type NOT IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT quest_id, '', 'required' FROM artifact a WHERE NOT EXISTS (SELECT 1 FROM objective o WHERE o.quest_id = a.quest_id)
    UNION ALL SELECT quest_id, 'objectives', 'minItems' FROM objective GROUP BY quest_id HAVING count(*) < 2
    UNION ALL SELECT quest_id, 'objectives', 'maxItems' FROM objective GROUP BY quest_id HAVING count(*) > 5
    UNION ALL SELECT quest_id, 'objectives.' || pos || '.action', 'pattern' FROM objective WHERE action NOT IN ('AF', 'RF')
    UNION ALL SELECT quest_id, 'objectives.' || pos || '.dep', 'maximum' FROM objective WHERE dep_no > 5""")
def schema_gate_json(v: Views) -> DataFrame:
    step = F.struct("pos", F.struct("action", F.col("dep_no").alias("dep")).alias("o"))
    steps = v.objective.groupBy("quest_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["o"]).alias("objectives"))
    rows = v.artifact.select("quest_id", "quest_type").join(steps, "quest_id", "left")
    json = rows.select("quest_id", F.parse_json(F.to_json(F.struct("quest_type", "objectives"))).alias("v"))
    return schema_gate(json, ORDER_SCHEMA).select("quest_id", "path", "keyword")


# Schema gate on typed rows: one row for each violated keyword


@table("events", "SELECT event_id, keyword FROM (SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'enum' END AS keyword FROM events UNION ALL SELECT event_id, CASE WHEN value > 100 THEN 'maximum' END FROM events) WHERE keyword IS NOT NULL")
def schema_enum(d: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(F.when(~F.col("event_type").isin("click", "view", "purchase"), "enum"), F.when(F.col("value") > 100, "maximum")))
    return d.select("event_id", F.explode(found).alias("keyword"))


@table("documents", "SELECT doc_id, keyword FROM (SELECT doc_id, CASE WHEN length(text) < 200 THEN 'minLength' END AS keyword FROM documents UNION ALL SELECT doc_id, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'pattern' END FROM documents) WHERE keyword IS NOT NULL")
def schema_length_pattern(d: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.length("text") < 200, "minLength"), F.when(~F.col("source").rlike("^src[0-9]$"), "pattern")))
    return d.select("doc_id", F.explode(found).alias("keyword"))


@over_views("SELECT quest_id, keyword FROM (SELECT a.quest_id, CASE WHEN count(o.pos) < 2 THEN 'minItems' WHEN count(o.pos) > 4 THEN 'maxItems' END AS keyword FROM artifact a LEFT JOIN objective o ON a.quest_id = o.quest_id GROUP BY a.quest_id) WHERE keyword IS NOT NULL")
def schema_cardinality(v: Views) -> DataFrame:
    n = v.artifact.select("quest_id").join(v.objective.groupBy("quest_id").agg(F.count("*").alias("n")), "quest_id", "left").select("quest_id", F.coalesce("n", F.lit(0)).alias("n"))
    return n.select("quest_id", F.when(F.col("n") < 2, "minItems").when(F.col("n") > 4, "maxItems").alias("keyword")).where("keyword is not null")


@over_views("SELECT quest_id FROM objective GROUP BY quest_id HAVING count(DISTINCT target) < count(*)")
def schema_unique(v: Views) -> DataFrame:
    return v.objective.groupBy("quest_id").agg(F.count_distinct("target").alias("d"), F.count("*").alias("n")).where("d < n").select("quest_id")


@table("events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def schema_variant_types(d: DataFrame) -> DataFrame:
    return d.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# Reports


def _rows(v: Views) -> DataFrame:
    return gates.report(v, gates.structural(v), ("referential", "graph"))


@over_views("SELECT quest_id, validator, errors, warnings, passed FROM grid")
def report_grid(v: Views) -> DataFrame:
    return _rows(v)


@over_views("SELECT validator, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings FROM grid GROUP BY validator")
def validator_summary(v: Views) -> DataFrame:
    return gates.validator_summary(_rows(v))


@over_views("SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(CAST(count(*) FILTER (WHERE passed) AS DOUBLE) / count(*), 6) AS rate FROM passes")
def acceptance_rate(v: Views) -> DataFrame:
    p = gates.artifact_passes(_rows(v)).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return p.select("total", "passed", _r(F.coalesce(F.try_divide(F.col("passed").cast("double"), "total"), F.lit(0.0)), "rate"))


@over_views("SELECT a.quest_id, a.quest_type FROM artifact a JOIN passes p ON a.quest_id = p.quest_id WHERE p.passed")
def publish(v: Views) -> DataFrame:
    return v.artifact.join(gates.artifact_passes(_rows(v)).where("passed"), "quest_id", "left_semi").select("quest_id", "quest_type")


@over_views("SELECT a.set_id, count(*) AS total, count(*) FILTER (WHERE p.passed) AS valid, count(*) FILTER (WHERE NOT p.passed) AS invalid, round(CAST(sum(p.errors) AS DOUBLE) / count(*), 6) AS avg_errors, round(CAST(sum(p.warnings) AS DOUBLE) / count(*), 6) AS avg_warnings FROM artifact a JOIN passes p ON a.quest_id = p.quest_id GROUP BY a.set_id")
def summarize(v: Views) -> DataFrame:
    p = v.artifact.select("quest_id", "set_id").join(gates.artifact_passes(_rows(v)), "quest_id")
    return p.groupBy("set_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("valid"), F.count_if(~F.col("passed")).alias("invalid"), _r(F.avg("errors"), "avg_errors"), _r(F.avg("warnings"), "avg_warnings"))


# Diversity


@over_views("SELECT quest_id, signature FROM sigs")
def signature(v: Views) -> DataFrame:
    return diversity.signatures(v).select("quest_id", "signature")


@over_views("SELECT signature, count(*) AS n FROM sigs GROUP BY signature")
def signature_counts(v: Views) -> DataFrame:
    return diversity.signatures(v).groupBy("signature").agg(F.count("*").alias("n"))


@over_views("SELECT round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM artifact) AS p FROM artifact GROUP BY quest_type)")
def entropy(v: Views) -> DataFrame:
    return diversity.entropy(v.artifact.groupBy("quest_type").agg(F.count("*").alias("n"))).select(_r("entropy", "entropy"))


@over_views("SELECT count(*) AS unique_signatures, round(CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM sigs GROUP BY signature)")
def dup_signature_rate(v: Views) -> DataFrame:
    return diversity.duplicate_rate(diversity.signatures(v)).select("unique_signatures", _r("duplicate_rate", "duplicate_rate"))


@over_views("SELECT ref AS entity_id, count(*) AS uses FROM refs GROUP BY ref")
def entity_usage(v: Views) -> DataFrame:
    return diversity.usage(v)


@over_views("SELECT CAST(sum(n) AS BIGINT) AS refs, count(*) AS used, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM entity), 6) AS coverage, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS concentration FROM (SELECT ref, count(*) AS n FROM refs GROUP BY ref)")
def coverage_concentration(v: Views) -> DataFrame:
    return diversity.coverage(v).select("refs", "used", _r("coverage", "coverage"), _r("concentration", "concentration"))


@table("nation", """SELECT round(avg(j), 6) AS similarity FROM (SELECT CAST(CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END + CASE WHEN substr(a.n_name, 1, 1) = substr(b.n_name, 1, 1) THEN 1 ELSE 0 END AS DOUBLE)
    / (4 - (CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END + CASE WHEN substr(a.n_name, 1, 1) = substr(b.n_name, 1, 1) THEN 1 ELSE 0 END)) AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)""")
def pairwise_jaccard(d: DataFrame) -> DataFrame:
    sets = d.select(F.col("n_nationkey").alias("quest_id"), F.array_sort(F.array(F.col("n_regionkey").cast("string"), F.substring("n_name", 1, 1))).alias("features"))
    return diversity.pairwise_similarity(sets).select(_r("similarity", "similarity"))


# Over all pairs of artifacts no SQL is fast enough; brute force on small views holds these two (tests/test_diversity.py).
@over_views()
def pairwise_similarity(v: Views) -> DataFrame:
    return diversity.pairwise_similarity(diversity.feature_sets(diversity.signatures(v))).select(_r("similarity", "similarity"))


@over_views()
def set_metrics(v: Views) -> DataFrame:
    m = diversity.set_metrics(v)
    return m.select(*[_r(c, c) if t == "double" else c for c, t in m.dtypes])


@over_views("SELECT quest_id, row_number() OVER (PARTITION BY signature ORDER BY ord) > 1 AS used_before FROM sigs")
def signature_already_used(v: Views) -> DataFrame:
    return diversity.already_used(diversity.signatures(v))


@over_views("SELECT entity_type, entity_id, uses FROM (SELECT e.entity_type, e.entity_id, coalesce(u.n, 0) AS uses, row_number() OVER (PARTITION BY e.entity_type ORDER BY coalesce(u.n, 0), e.entity_id) AS k FROM entity e LEFT JOIN (SELECT ref, count(*) AS n FROM refs GROUP BY ref) u ON u.ref = e.entity_id) WHERE k = 1")
def least_used_entity(v: Views) -> DataFrame:
    return diversity.least_used(v)


# Faults and scores

WRONG = "nation_1"


def _by_fault(v: Views, some: tuple[str, ...]) -> DataFrame:
    return faults.caught(v, F.lit(WRONG), some).select("fault_type", "total", "detected")


def _by_validator(v: Views, some: tuple[str, ...]) -> DataFrame:
    return faults.caught(v, F.lit(WRONG), some).groupBy("validator").agg(F.sum("detected").cast("long").alias("tp")).where("tp > 0")


@over_views("SELECT fault_type, count(*) AS mutants FROM artifact CROSS JOIN (VALUES ('unknown_target'), ('wrong_giver_type'), ('duplicate_step_id'), ('missing_dependency'), ('cyclic_dependency')) f(fault_type) GROUP BY fault_type")
def mutants(v: Views) -> DataFrame:
    return faults.mutants(v, F.lit(WRONG))[1].groupBy("fault_type").agg(F.count("*").alias("mutants"))


@over_views("""SELECT 'unknown_target' AS fault_type, (SELECT count(*) FROM artifact) AS total, count(DISTINCT quest_id) AS detected FROM objective
    UNION ALL SELECT 'wrong_giver_type', (SELECT count(*) FROM artifact), (SELECT count(*) FROM artifact)
    UNION ALL SELECT 'missing_dependency', (SELECT count(*) FROM artifact), count(DISTINCT quest_id) FROM objective""")
def fault_detection_by_fault(v: Views) -> DataFrame:
    return _by_fault(v, ("unknown_target", "wrong_giver_type", "missing_dependency"))


@over_views("""SELECT 'referential' AS validator, (SELECT count(*) FROM artifact) + (SELECT count(DISTINCT quest_id) FROM objective) AS tp UNION ALL SELECT 'graph', count(DISTINCT quest_id) FROM objective""")
def fault_detection_by_validator(v: Views) -> DataFrame:
    return _by_validator(v, ("unknown_target", "wrong_giver_type", "missing_dependency"))


# All faults of FAULTS; the mutants' own gates hold them, on small views, against hand-made cases (tests/test_faults.py).
@over_views()
def fault_detection_all_by_fault(v: Views) -> DataFrame:
    return _by_fault(v, tuple(faults.FAULTS))


@over_views()
def fault_detection_all_by_validator(v: Views) -> DataFrame:
    return _by_validator(v, tuple(faults.FAULTS))


@query("""SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy
    FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND length(text) < 400) AS tp, count(*) FILTER (WHERE toxic = 0 AND length(text) < 400) AS fp, count(*) FILTER (WHERE toxic = 1 AND length(text) >= 400) AS fn, count(*) FILTER (WHERE toxic = 0 AND length(text) >= 400) AS tn FROM labels JOIN documents ON labels.doc_id = documents.doc_id)""")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.length("text") < 400).alias("p"))
    j = spark.read.parquet(f"{sf_dir}/labels.parquet").join(d, "doc_id").select((F.col("toxic") == 1).alias("t"), "p")
    n = j.agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn"))
    s = n.select("*", *faults.scores(*map(F.col, ("tp", "fp", "fn", "tn"))))
    return s.select("tp", "fp", "fn", "tn", *[_r(c, c) for c in ("precision", "recall", "f1", "accuracy")])


# Numbering, sets, text


@over_views("SELECT quest_id, pos, 'step_' || lpad(CAST(pos + 1 AS VARCHAR), 3, '0') AS step_id, CASE WHEN pos > 0 THEN 'step_' || lpad(CAST(pos AS VARCHAR), 3, '0') END AS depends_on FROM objective")
def renumber_steps(v: Views) -> DataFrame:
    step = lambda c: F.format_string("step_%03d", c)
    return v.objective.select("quest_id", "pos", step(F.col("pos") + 1).alias("step_id"), F.when(F.col("pos") > 0, step(F.col("pos"))).alias("depends_on"))


@table("conversations", "SELECT conv_id, turn, (1234 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2147483647 AS seed FROM conversations")
def request_seeds(d: DataFrame) -> DataFrame:
    return d.select("conv_id", "turn", F.pmod(F.lit(1234) + F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1, F.lit(2147483647)).alias("seed"))


@table("conversations", "SELECT conv_id, turn, 'batch_' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '_item_' || lpad(CAST(k AS VARCHAR), 3, '0') AS name FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)")
def batch_numbering(d: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return d.select("conv_id", "turn", F.format_string("batch_%06d_item_%03d", "conv_id", k).alias("name"))


@table("conversations", "SELECT conv_id, turn, taken FROM (SELECT conv_id, turn, greatest(0, least(length(text), 500 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)))) AS taken FROM conversations) WHERE taken > 0")
def quota(d: DataFrame) -> DataFrame:
    n = F.length("text").cast("long")
    before = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - n
    return d.select("conv_id", "turn", F.greatest(F.lit(0), F.least(n, F.lit(500) - before)).cast("long").alias("taken")).where("taken > 0")


@over_views("SELECT quest_id, quest_type FROM artifact ORDER BY ord LIMIT 20")
def first_n(v: Views) -> DataFrame:
    return v.artifact.orderBy("ord").limit(20).select("quest_id", "quest_type")


@table("documents", "SELECT min(doc_id) AS doc_id, md5(text) AS fingerprint, count(*) AS copies FROM documents GROUP BY text")
def fingerprint_dedupe(d: DataFrame) -> DataFrame:
    return d.groupBy(F.md5(F.col("text").cast("binary")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@over_views("SELECT giver, quest_id FROM (SELECT giver, quest_id, row_number() OVER (PARTITION BY giver ORDER BY ord) AS k FROM artifact) WHERE k = 1")
def dedupe_first_wins(v: Views) -> DataFrame:
    return v.artifact.groupBy("giver").agg(F.min(F.struct("ord", "quest_id")).alias("s")).select("giver", "s.quest_id")


@table("documents", r"SELECT doc_id, CASE WHEN s = '' THEN 'quest' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)")
def slug_ascii(d: DataFrame) -> DataFrame:
    return d.select("doc_id", ascii_slug(F.col("text")).alias("slug"))


@table("documents")
def slug_accents(d: DataFrame) -> DataFrame:
    return d.select("doc_id", slug("text").alias("slug"))


@table("documents", r"SELECT doc_id, CASE WHEN s = '' THEN 'quest' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)")
def slug_ascii_whole(d: DataFrame) -> DataFrame:
    """As q_slug_ascii."""
    return d.select("doc_id", ascii_slug(F.col("text")).alias("slug"))


# Experiments


@over_views("SELECT quest_type, count(*) AS n, round(avg(errors), 6) AS mean, round(coalesce(stddev_samp(errors), 0), 6) AS stdev, CAST(min(errors) AS BIGINT) AS lo, CAST(max(errors) AS BIGINT) AS hi FROM artifact a JOIN passes p ON a.quest_id = p.quest_id GROUP BY quest_type")
def numeric_summary(v: Views) -> DataFrame:
    p = v.artifact.select("quest_id", "quest_type").join(gates.artifact_passes(_rows(v)), "quest_id")
    return p.groupBy("quest_type").agg(F.count("*").alias("n"), _r(F.avg("errors"), "mean"), _r(F.coalesce(F.stddev_samp("errors"), F.lit(0.0)), "stdev"), F.min("errors").alias("lo"), F.max("errors").alias("hi"))


@table("documents", "SELECT source, count(DISTINCT sha256(text)) = count(*) AS intact FROM documents GROUP BY source")
def run_integrity(d: DataFrame) -> DataFrame:
    return d.groupBy("source").agg((F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)) == F.count("*")).alias("intact"))


@over_views("SELECT metric, a, b, round(b - a, 6) AS delta FROM (SELECT 'errors' AS metric, round(avg(errors) FILTER (WHERE set_id = 1), 6) AS a, round(avg(errors) FILTER (WHERE set_id = 2), 6) AS b FROM artifact x JOIN passes p ON x.quest_id = p.quest_id UNION ALL SELECT 'warnings', round(avg(warnings) FILTER (WHERE set_id = 1), 6), round(avg(warnings) FILTER (WHERE set_id = 2), 6) FROM artifact x JOIN passes p ON x.quest_id = p.quest_id)")
def compare_delta(v: Views) -> DataFrame:
    p = v.artifact.select("quest_id", "set_id").join(gates.artifact_passes(_rows(v)), "quest_id")
    mean = lambda c, s: F.round(F.avg(F.when(F.col("set_id") == s, F.col(c))), 6)
    wide = p.agg(*[mean(c, s).alias(f"{c}_{s}") for c in ("errors", "warnings") for s in (1, 2)])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_1").alias("a"), F.col(f"{c}_2").alias("b")) for c in ("errors", "warnings")])
    return wide.select(F.inline(rows)).select("metric", "a", "b", _r(F.col("b") - F.col("a"), "delta"))


@over_views("SELECT set_id, 'errors' AS metric, CAST(sum(errors) AS BIGINT) AS value FROM artifact a JOIN passes p ON a.quest_id = p.quest_id GROUP BY set_id UNION ALL SELECT set_id, 'warnings', CAST(sum(warnings) AS BIGINT) FROM artifact a JOIN passes p ON a.quest_id = p.quest_id GROUP BY set_id")
def long_metrics(v: Views) -> DataFrame:
    p = v.artifact.select("quest_id", "set_id").join(gates.artifact_passes(_rows(v)), "quest_id").groupBy("set_id").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    return p.unpivot("set_id", ["errors", "warnings"], "metric", "value")


@table("labels", "SELECT doc_id, greatest(0, least(5, quality * 7 - toxic * 3)) AS score FROM labels")
def score_clip_mean(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.greatest(F.lit(0), F.least(F.lit(5), F.col("quality") * 7 - F.col("toxic") * 3)).alias("score"))
