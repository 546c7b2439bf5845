"""Artifacts judged for evolving diversity: one lookup and one gathering against the functions that do it apart, and uses with repeats."""

from gatewright.operators import diversity, gates
from gatewright.plans import front_catalog
from gatewright.sources.views import Views, compat_table, from_tables

SF = "/root/testdata/sf0.001"


def odd_views(spark):
    artifact = spark.createDataFrame(
        [(1, "x", "g1", "n1", 0, 1), (2, "x", None, " n1 ", 0, 2), (3, "x", "gone", None, 0, 3), (4, "x", None, None, 0, 4), (5, "x", "g1", "n1", 0, 5)],
        "quest_id long, quest_type string, giver string, start string, set_id long, ord long",
    )
    steps = [(1, 1, 2, "RO", "p1", 1), (1, 0, 1, "AF", "p1", 2), (2, 0, 1, None, "p2", 0), (2, 1, 2, " Ro ", None, None), (2, 2, 3, "RO", "gone", 2), (5, 0, 1, "RO", "p3", 1), (9, 0, 1, "RO", "p1", 0)]
    objective = spark.createDataFrame(steps, "quest_id long, pos long, step_no long, action string, target string, dep_no long")
    reward = spark.createDataFrame([(1, 0, "item", "p1"), (2, 0, "item", None), (3, 0, "currency", "p1"), (3, 1, "item", "p2")], "quest_id long, pos long, type string, value string")
    entity = spark.createDataFrame([("p1", "small"), ("p2", "large"), ("p3", None), ("g1", "customer"), ("n1", "nation")], "entity_id string, entity_type string")
    return Views(artifact, objective, reward, entity, compat_table(spark, {"RO": ("small",)}), "customer", "nation", ("small",))


def apart(v):
    out = {r.quest_id: [r.signature, [], False] for r in diversity.signatures(v).collect()}
    for r in diversity.references(v).collect():
        if r.quest_id in out:
            out[r.quest_id][1].append(r.entity_id)
    for r in gates.graph_facts(v).collect():
        if r.quest_id in out:
            out[r.quest_id][2] = r.cyclic
    return {k: (s, sorted(es), c) for k, (s, es, c) in out.items()}


def test_described_is_what_its_parts_are(spark):
    for v in (odd_views(spark), from_tables(spark, SF)):
        want = apart(v)
        found = {r.quest_id: (r.signature, sorted(r.entities), r.cyclic) for r in diversity.described(v).collect()}
        assert {k: found.get(k, ("", [], False)) for k in want} == want
    assert want and any(c for _, _, c in want.values()) and any(len(set(es)) < len(es) for _, es, _ in apart(odd_views(spark)).values())


def test_orders_are_looked_up_once_and_not_numbered(spark):
    plan = front_catalog.judged_orders(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 0 and plan.count("Join ") == 2


def test_place_has_the_order_of_pos(spark):
    from pyspark.sql import functions as F

    rows = from_tables(spark, SF).objective.groupBy("quest_id").agg(*[F.transform(F.sort_array(F.collect_list(F.struct(c, "target"))), lambda s: s["target"]).alias(c) for c in ("pos", "place")])
    assert rows.where("pos != place").isEmpty() and not rows.isEmpty()


def test_uses_are_dealt_twice_only(spark):
    judged = [("s", i, f"q{i}", "a:x -> a:x -> b:x", ["e", "e", "f"], i != 1) for i in range(4)]
    df = diversity.evolving(spark.createDataFrame(judged, "set_id string, ord long, quest_id string, signature string, entities array<string>, passed boolean"))
    found = [(r.registered, r.signature_uses, r.component_uses, r.entity_uses) for r in sorted(df.collect(), key=lambda r: r.ord)]
    assert found == [(True, 0, 0, 0), (False, 1, 3, 3), (True, 1, 3, 3), (True, 2, 6, 6)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1  # back by row; repeats of a row are not gathered before
