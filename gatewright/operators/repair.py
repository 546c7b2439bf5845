"""Deterministic repair of JSON artifacts, and its orchestration: gates, repair, recorded responses, routing, summary.

Repair is a projection of each artifact's VARIANT: references are looked up by one join with the catalog (exploded, resolved, and
gathered by artifact), all rules are column expressions that read what earlier rules gave, and each rule that changes something adds a row to changes.
Rules: scalar fields, core references, objectives, preconditions, completion conditions, rewards, tags, design notes.
Constraints (least and most items, least lengths, enumerations) are read from the JSON Schema while the plan is built.

Differences from artifacts' own values are told by their JSON. A field that is neither a string nor missing counts as its JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_slug, clean, slugs
from ..sources.artifacts import at, elements, is_object, kind, numbered, objects
from ..sources.scratch import keep as stored
from .gates import union

#: Entity types that each action's target may have.
ACTION_TYPES = {
    "talk": ("npc",),
    "return": ("npc", "location"),
    "collect": ("item", "object"),
    "deliver": ("npc", "location"),
    "visit": ("location",),
    "travel": ("location",),
    "investigate": ("location", "item", "object", "npc"),
    "inspect": ("location", "item", "object"),
    "interact": ("npc", "item", "object", "location"),
    "defeat": ("enemy", "npc"),
    "protect": ("npc", "location", "object"),
    "rescue": ("npc",),
    "escort": ("npc",),
    "use": ("item", "object"),
    "unlock": ("location", "object"),
}
#: The action that suits a target of a type.
TYPE_ACTION = {"npc": "talk", "location": "travel", "item": "collect", "object": "inspect", "enemy": "defeat", "faction": "interact"}
#: Texts of repaired fields; {0} is the target, title or action that the text is about, {1} the target.
CONDITIONS = {
    "talk": "O jogador conclui o diálogo com {0}.",
    "return": "O jogador retorna com sucesso para {0}.",
    "collect": "O inventário do jogador contém {0}.",
    "deliver": "O jogador entrega o recurso solicitado para {0}.",
    "visit": "O jogador alcança e visita {0}.",
    "travel": "O jogador alcança a localização {0}.",
    "investigate": "O jogador conclui a investigação relacionada a {0}.",
    "inspect": "O jogador inspeciona completamente {0}.",
    "interact": "O jogador conclui a interação com {0}.",
    "defeat": "A entidade {0} foi derrotada pelo jogador.",
    "protect": "O jogador protege {0} até o fim da etapa.",
    "rescue": "A entidade {0} foi resgatada com sucesso.",
    "escort": "O jogador escolta {0} até o destino definido.",
    "use": "O jogador utiliza {0} na situação prevista.",
    "unlock": "O jogador desbloqueia {0}.",
}
OTHER_CONDITION = "O jogador conclui a ação {0} sobre {1}."
NEW_ID, NEW_TITLE, NEW_SUMMARY = "quest_repaired_001", "Missão restaurada", "O jogador deve concluir os objetivos definidos para {0}."
NEW_PRECONDITION, NEW_COMPLETION = "O jogador ainda não concluiu esta quest.", "A condição final da quest foi satisfeita pelo jogador."
NOTES = {
    "intended_player_experience": "Permitir que o jogador avance de forma clara pelos objetivos de {0}.",
    "reuse_potential": "A estrutura pode ser reutilizada com outras entidades, locais e recompensas.",
    "integration_notes": "A integração requer rastreamento de objetivos, dependências e condições de conclusão.",
}
#: What a repaired artifact keeps of the original.
PRESERVED = ("quest_id", "generation_batch", "generation_index_in_batch", "generation_global_index", "generation_mode", "generation_model")
TYPES = ("npc", "location", "item", "faction", "enemy", "object")


def constraint(schema: dict[str, Any], path: tuple[str, ...], key: str, default: int | None) -> int | None:
    """A whole number of the schema's node at path (names of nested keys), or the default."""
    node: Any = schema
    for part in path:
        node = node.get(part, {}) if isinstance(node, dict) else {}
    value = node.get(key, default) if isinstance(node, dict) else default
    return value if isinstance(value, int) and value >= 0 else default


def enumeration(schema: dict[str, Any], *path: str) -> list[str]:
    node: Any = schema
    for part in path:
        node = node.get(part, {}) if isinstance(node, dict) else {}
    return list(node.get("enum", []))


def said(text: str, about: Column) -> Column:
    """A text of the tables above about a column; a text about nothing is as it is."""
    before, mark, after = text.partition("{0}")
    return F.concat(F.lit(before), about, F.lit(after)) if mark else F.lit(text)


def table(values: dict[str, Any]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def looked_up(values: dict[str, Any], key: Column) -> Column:
    """The value of key in a small fixed table; null if it has none."""
    known = {k: v for k, v in values.items() if v is not None}
    return F.try_element_at(table(known), key) if known else F.lit(None).cast("string")


def condition(action: Column, target: Column) -> Column:
    text = F.coalesce(looked_up(CONDITIONS, action), F.replace(F.lit(OTHER_CONDITION.replace("{0}", "{a}").replace("{1}", "{0}")), F.lit("{a}"), action))
    return F.replace(text, F.lit("{0}"), target)


@dataclass(frozen=True)
class Firsts:
    """The alphabetically first entity of each type, and as many npcs as an artifact may rule out, and one more."""

    first: dict[str, str]
    npcs: tuple[str, ...]

    def target(self) -> dict[str, str | None]:
        """For each action, the first entity of the alphabetically first type that suits it and has any."""
        return {a: next((self.first[t] for t in sorted(ts) if t in self.first), None) for a, ts in ACTION_TYPES.items()}


def firsts(entity: DataFrame, most_excluded: int) -> Firsts:
    by_type = {r.entity_type: r.id for r in entity.groupBy("entity_type").agg(F.min("entity_id").alias("id")).collect()}
    npcs = entity.where("entity_type = 'npc'").select("entity_id").distinct().orderBy("entity_id").limit(most_excluded + 1).collect()
    return Firsts(by_type, tuple(r.entity_id for r in npcs))


def parsed(artifacts: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """quest_id, ord, v, and the fields that rules read: p (a struct)."""
    v = F.col("v")
    field = lambda k: clean(at(v, k)).alias(k)
    step = lambda s: F.struct(F.lower(clean(s["action"])).alias("action"), clean(s["target"]).alias("target"), clean(s["success_condition"]).alias("success"))
    every = F.transform(objects(at(v, "objectives"), ("action", "target", "success_condition")), step)
    most = constraint(schema, ("properties", "objectives"), "maxItems", None)
    reward = lambda s: F.struct(clean(at(s["v"], "type")).alias("type"), clean(at(s["v"], "value")).alias("ref"), at(s["v"], "value").alias("value"))
    rescued = F.array_distinct(F.transform(F.filter(every, lambda s: s["action"] == "rescue"), lambda s: s["target"]))
    fields = [field(k) for k in ("quest_id", "title", "summary", "quest_type", "giver_npc", "start_location")]
    p = F.struct(*fields, (every if most is None else F.slice(every, 1, most)).alias("steps"), rescued.alias("rescued"), F.transform(numbered(at(v, "rewards")), reward).alias("rewards"))
    return artifacts.select("quest_id", "ord", "v", p.alias("p"))


def with_types(rows: DataFrame, entity: DataFrame) -> DataFrame:
    """rows with types: the entity type of each reference that the catalog has."""
    refs = F.concat(F.array("p.giver_npc", "p.start_location"), F.transform("p.steps", lambda s: s["target"]), F.transform("p.rewards", lambda r: r["ref"]))
    each = rows.select("quest_id", "ord", F.explode(F.array_distinct(refs)).alias("ref")).join(entity.select(F.col("entity_id").alias("ref"), "entity_type"), "ref")
    types = each.groupBy("quest_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("ref", "entity_type"))).alias("types"))
    return rows.join(types, ["quest_id", "ord"], "left").withColumn("types", F.coalesce("types", F.expr("cast(map() as map<string,string>)")))


def type_of(ref: Column) -> Column:
    return F.try_element_at(F.col("types"), ref)


def scalars(schema: dict[str, Any]) -> dict[str, tuple[str, Column, Column]]:
    """For each field: the change code, whether it is changed, and its new text."""
    p = lambda k: F.col(f"p.{k}")
    title = F.when(F.length(p("title")) < 3, NEW_TITLE).otherwise(p("title"))
    kinds = enumeration(schema, "properties", "quest_type")
    default = "exploration" if "exploration" in kinds else min(kinds, default="")
    bad_kind = ~p("quest_type").isin(kinds) if kinds else F.lit(False)
    short = F.length(p("summary")) < constraint(schema, ("properties", "summary"), "minLength", 20)
    own_id = F.coalesce(kind(at(F.col("v"), "quest_id")) == "STRING", F.lit(False)) & (at(F.col("v"), "quest_id").cast("string") == p("quest_id")) & (p("quest_id") != "")
    return {
        "quest_id": ("FILL_QUEST_ID", ~F.coalesce(own_id, F.lit(False)), F.when(p("quest_id") == "", NEW_ID).otherwise(p("quest_id"))),
        "title": ("FILL_TITLE", F.length(p("title")) < 3, F.lit(NEW_TITLE)),
        "summary": ("EXPAND_SUMMARY", short, said(NEW_SUMMARY, title)),
        "quest_type": ("NORMALIZE_QUEST_TYPE", bad_kind, F.lit(default)),
    }


def core_references() -> dict[str, tuple[Column, Column, Column]]:
    """For each field: the change code, whether it is changed, and its new text, from the columns free_npc and first_location."""
    giver, start, rescued, free = F.col("p.giver_npc"), F.col("p.start_location"), F.col("p.rescued"), F.col("free_npc")
    own = F.array_contains(rescued, giver) & (giver != "")
    bad_giver = (~F.coalesce(type_of(giver) == "npc", F.lit(False)) | own) & free.isNotNull()
    bad_start = ~F.coalesce(type_of(start) == "location", F.lit(False)) & F.col("first_location").isNotNull()
    return {
        "giver_npc": (F.when(own, "CHANGE_SELF_RESCUE_GIVER").otherwise("REPAIR_GIVER_NPC"), bad_giver, free),
        "start_location": (F.lit("REPAIR_START_LOCATION"), bad_start, F.col("first_location")),
    }


STEP = "struct<action: string, target: string, success: string, type: string>"


def support(steps: Column, f: Firsts, giver: Column, giver_type: Column, start: Column, start_type: Column) -> Column:
    """The objective to put before steps: talk to the giver, travel to the start, return to the giver, or travel."""
    done = F.transform(steps, lambda s: s["action"])
    made = lambda a, t, ty: F.struct(F.lit(a).alias("action"), t.alias("target"), said(CONDITIONS[a], t).alias("success"), ty.alias("type")).cast(STEP)
    npc, place = F.coalesce(giver_type == "npc", F.lit(False)), F.coalesce(start_type == "location", F.lit(False))
    last = F.when(start != "", start).otherwise(F.lit(f.first.get("location", "unknown_target")))
    last_type = F.when(start != "", start_type).otherwise(F.lit("location" if "location" in f.first else None))
    return (
        F.when(~F.array_contains(done, "talk") & npc, made("talk", giver, giver_type))
        .when(~F.array_contains(done, "travel") & place, made("travel", start, start_type))
        .when(npc, made("return", giver, giver_type))
        .otherwise(made("travel", last, last_type))
    )


def normal_steps(steps: Column, f: Firsts, actions: list[str], start: Column) -> Column:
    """Objectives with a known action and a target that suits it: the target is replaced first."""
    suits = lambda ty: F.coalesce(looked_up(TYPE_ACTION, ty), F.lit("interact"))
    pairs = F.array(*[F.lit(f"{a}:{t}") for a, ts in ACTION_TYPES.items() for t in ts])
    place = F.when(start != "", start).otherwise(F.lit(f.first.get("location", "unknown_target")))
    acting = F.transform(steps, lambda s: F.struct(F.when(s["action"].isin(actions), s["action"]).otherwise(suits(s["type"])).alias("action"), s["target"].alias("target"), s["success"].alias("success"), s["type"].alias("type")))

    def judged(s: Column) -> Column:
        limited = s["action"].isin(list(ACTION_TYPES))
        fits = F.array_contains(pairs, F.concat_ws(":", s["action"], s["type"]))
        return F.struct(s["action"].alias("action"), s["target"].alias("target"), s["success"].alias("success"), s["type"].alias("type"), (s["type"].isNull() | (limited & ~fits)).alias("bad"), looked_up(f.target(), s["action"]).alias("other"))

    def settled(s: Column) -> Column:
        stuck = s["bad"] & s["other"].isNull()
        action = F.when(stuck & s["type"].isNull(), "travel").when(stuck, suits(s["type"])).otherwise(s["action"])
        target = F.when(s["bad"] & s["other"].isNotNull(), s["other"]).when(stuck & s["type"].isNull(), place).otherwise(s["target"])
        return F.struct(action.alias("action"), target.alias("target"), s["success"].alias("success"))

    told = lambda s: F.struct(s["action"].alias("action"), s["target"].alias("target"), F.when(F.length(s["success"]) < 12, condition(s["action"], s["target"])).otherwise(s["success"]).alias("success_condition"))
    return F.transform(F.transform(F.transform(acting, judged), settled), told)


def renumbered(steps: Column) -> Column:
    name = lambda i: F.format_string("step_%03d", i)
    before = lambda i: F.when(i == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(name(i)))
    return F.transform(steps, lambda s, i: F.struct(name(i + 1).alias("step_id"), before(i).alias("depends_on"), s["action"].alias("action"), s["target"].alias("target"), s["success_condition"].alias("success_condition")))


def _json(c: Column) -> Column:
    return F.parse_json(F.to_json(c))


def _padded(xs: Column, least: int, filler: Column) -> Column:
    return F.when(F.size(xs) < least, F.concat(xs, F.array_repeat(filler, F.lit(least) - F.size(xs)))).otherwise(xs)


def strings(v: Column, least_length: int) -> Column:
    texts = F.transform(F.filter(elements(v), lambda x: kind(x) == "STRING"), clean)
    return F.filter(texts, lambda t: F.length(t) >= least_length)


def repaired_rewards(least: int) -> Column:
    item = F.col("first_item")
    numeric = lambda v: kind(v).isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL", "BOOLEAN")

    def value(r: Column) -> Column:
        money = F.when(F.coalesce(numeric(r["value"]), F.lit(False)), r["value"]).otherwise(F.lit(100).cast("variant"))
        goods = F.when(F.coalesce(type_of(r["ref"]) == "item", F.lit(False)), r["value"]).otherwise(item.cast("variant"))
        unlock = F.when(r["ref"] == "", "quest_progression").otherwise(r["ref"]).cast("variant")
        return F.when(r["type"] == "item", goods).when(r["type"].isin("currency", "reputation"), money).when(r["type"] == "unlock", unlock)

    made = F.transform("p.rewards", lambda r: F.struct(r["type"].alias("type"), value(r).alias("value")))
    kept = F.filter(made, lambda r: r["value"].isNotNull())
    return _padded(kept, least, F.struct(F.lit("currency").alias("type"), F.lit(100).cast("variant").alias("value")))


def repaired_notes(title: Column, schema: dict[str, Any]) -> Column:
    notes = at(F.col("v"), "design_notes")
    own = F.coalesce(F.when(is_object(notes), F.try_variant_get(notes, "$", "map<string,variant>")), F.expr("cast(map() as map<string,variant>)"))
    new = []
    for name, text in NOTES.items():
        now = clean(at(notes, name))
        least = constraint(schema, ("properties", "design_notes", "properties", name), "minLength", 12)
        new += [F.lit(name), F.when(F.when(is_object(notes), F.length(now)).otherwise(0) < least, said(text, title)).otherwise(now).cast("variant")]
    return F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(list(NOTES))), F.create_map(*new)))


def repair(artifacts: DataFrame, entity: DataFrame, schema: dict[str, Any], fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """quest_id, ord, v (the artifact), r (repaired), changes (array of code, path, before, after: JSON) of keyed artifacts.

    fold: from these rows to their quest_id, ord, free_npc, first_location, first_item and chosen objectives, where choices are
    to depend on other artifacts (see diversity_repair)."""
    return _repaired(artifacts, entity, schema, fold).select("quest_id", "ord", "v", "r", "changes")


def change_codes(artifacts: DataFrame, entity: DataFrame, schema: dict[str, Any], codes: tuple[str, ...]) -> DataFrame:
    """quest_id, code of repair's changes with one of these codes. Rules of other codes are not evaluated unless these read what they give, and no
    change is written as text."""
    rows = _repaired(artifacts, entity, schema, None, codes).select("quest_id", F.explode_outer("codes").alias("code"))  # explode would have a filter that makes the codes once more
    return rows.where(F.col("code").isin(*codes))


def _repaired(artifacts: DataFrame, entity: DataFrame, schema: dict[str, Any], fold: Callable[[DataFrame], DataFrame] | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """See repair; with codes: the codes of changes alone (of those in only, as far as a rule has one code)."""
    read = stored(parsed(artifacts, schema), "parsed")  # read three times: for names that are ruled out, for references, and for the rules
    most = read.agg(F.max(F.size("p.rescued"))).first()[0] or 0
    rows = with_types(read, entity)
    f = firsts(entity, most)
    kinds, title_of = scalars(schema)["quest_type"], scalars(schema)["title"]
    rows = rows.withColumn("kind", F.when(kinds[1], kinds[2]).otherwise(F.col("p.quest_type")))
    if fold is None:
        free = F.try_element_at(F.filter(F.array(*map(F.lit, f.npcs)).cast("array<string>"), lambda x: ~F.array_contains("p.rescued", x)), F.lit(1))
        rows = rows.select("*", free.alias("free_npc"), F.lit(f.first.get("location")).alias("first_location"), F.lit(f.first.get("item")).alias("first_item"))
    else:
        rows = rows.join(fold(rows), ["quest_id", "ord"])
    v, changes, codes = F.col("v"), [], []
    asked = lambda code: only is None or code in only
    change = lambda code, path, before, after: F.struct(code.alias("code"), F.lit(path).alias("path"), F.to_json(before).alias("before"), F.to_json(after).alias("after"))
    new: dict[str, Column] = {}
    for key, (code, changed, text) in scalars(schema).items():
        new[key] = F.when(changed, text.cast("variant")).otherwise(at(v, key))
        changes.append(F.when(changed, change(F.lit(code), key, at(v, key), text.cast("variant"))))
        if asked(code):
            codes.append(F.when(changed, F.lit(code)))
    for key, (code, changed, text) in core_references().items():
        new[key] = F.when(changed, text.cast("variant")).otherwise(at(v, key))
        changes.append(F.when(changed, change(code, key, at(v, key), text.cast("variant"))))
        codes.append(F.when(changed, code))
    refs = core_references()
    pick = lambda k, t: F.when(refs[k][1], t[0]).otherwise(t[1])
    giver, start = (pick(k, (refs[k][2], F.col(f"p.{k}"))) for k in ("giver_npc", "start_location"))
    giver_type, start_type = (pick(k, (F.lit(t), type_of(F.col(f"p.{k}")))) for k, t in (("giver_npc", "npc"), ("start_location", "location")))
    rows = rows.select("*", giver.alias("giver"), giver_type.alias("giver_type"), start.alias("start"), start_type.alias("start_type"), F.transform("p.steps", lambda s: F.struct(s["action"].alias("action"), s["target"].alias("target"), s["success"].alias("success"), type_of(s["target"]).alias("type")).cast(STEP)).alias("steps"))
    least = constraint(schema, ("properties", "objectives"), "minItems", 1)
    for _ in range(least if fold is None else 0):
        more = F.concat(F.array(support(F.col("steps"), f, *map(F.col, ("giver", "giver_type", "start", "start_type")))), "steps")
        rows = rows.withColumn("steps", F.when(F.size("steps") < least, more).otherwise(F.col("steps")))
    actions = enumeration(schema, "properties", "objectives", "items", "properties", "action")
    rows = rows.withColumn("done", renumbered(normal_steps(F.col("steps"), f, actions, F.col("start")) if fold is None else F.col("chosen")))
    items = lambda k, d: constraint(schema, ("properties", k), "minItems", d)
    last = F.coalesce(F.try_element_at(F.transform("done", lambda s: s["success_condition"]), F.lit(-1)), F.lit(NEW_COMPLETION))
    quest_type = F.col("kind")
    title = F.when(title_of[1], title_of[2]).otherwise(F.col("p.title"))
    own_tags = F.array_distinct(slugs(F.transform(elements(at(v, "reusable_tags")), clean)))
    fill = F.array_distinct(F.concat(F.array(ascii_slug(quest_type)), F.transform("done", lambda s: s["action"]), F.array(F.lit("structured_quest"), F.lit("world_grounded"))))
    rows = rows.withColumn("tags", own_tags)
    short = F.greatest(F.lit(items("reusable_tags", 0)) - F.size("tags"), F.lit(0))
    lists = {
        "objectives": ("NORMALIZE_OBJECTIVES" if fold is None else "DIVERSITY_AWARE_OBJECTIVE_REPAIR", _json(F.col("done"))),
        "preconditions": ("NORMALIZE_PRECONDITIONS", _json(_padded(strings(at(v, "preconditions"), 1), items("preconditions", 0), F.lit(NEW_PRECONDITION)))),
        "completion_conditions": ("NORMALIZE_COMPLETION_CONDITIONS", _json(_padded(strings(at(v, "completion_conditions"), 12), items("completion_conditions", 1), last))),
        "rewards": ("NORMALIZE_REWARDS", F.to_variant_object(repaired_rewards(items("rewards", 1)))),
        "reusable_tags": ("NORMALIZE_TAGS", _json(F.concat("tags", F.slice(F.array_except(fill, F.col("tags")), F.lit(1), short)))),
        "design_notes": ("NORMALIZE_DESIGN_NOTES", repaired_notes(title, schema)),
    }
    for key, (_, value) in lists.items():
        rows = rows.withColumn(f"new_{key}", value)
    for key, (code, _) in lists.items():
        new[key] = F.col(f"new_{key}")
        changed = ~F.to_json(at(v, key)).eqNullSafe(F.to_json(new[key]))
        changes.append(F.when(changed, change(F.lit(code), key, at(v, key), new[key])))
        if asked(code):
            codes.append(F.when(changed, F.lit(code)))
    entries = F.create_map(*[x for k, c in new.items() for x in (F.lit(k), c)])
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(list(new)))
    merged = F.map_filter(F.map_concat(others, entries), lambda _, x: x.isNotNull())
    return rows.select("quest_id", "ord", "v", F.to_variant_object(merged).alias("r"), F.array_compact(F.array(*changes)).alias("changes"), F.array_compact(F.array(*codes)).alias("codes"))


def preserving(original: Column, repaired: Column) -> Column:
    """The repaired artifact with the original's identity and generation fields, where the original has them."""
    own = F.map_filter(F.try_variant_get(original, "$", "map<string,variant>"), lambda k, _: k.isin(list(PRESERVED)))
    rest = F.map_filter(F.try_variant_get(repaired, "$", "map<string,variant>"), lambda k, _: ~F.map_contains_key(own, k))
    return F.to_variant_object(F.map_concat(rest, own))


Gate = Callable[[DataFrame], DataFrame]


def orchestrate(artifacts: DataFrame, entity: DataFrame, schema: dict[str, Any], gate: Gate, keep: Callable[[DataFrame, str], DataFrame], responses: DataFrame | None = None, attempts: int = 3, recover: Callable[[Column], Column] | None = None, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A record for each keyed artifact: quest_id, ord, v (as it came), r (as it ends), attempts, repaired, passed, errors,
    warnings, changes.

    gate gives issue rows of (quest_id, v). Artifacts that fail are repaired; those that still fail take the recorded
    responses (quest_id, attempt, response) in order, one round each, repaired too; a response without an artifact only counts. keep(df, name) writes a table and
    reads it back, so that rounds do not repeat the work before them."""

    def judged(df: DataFrame) -> DataFrame:
        n = gate(df.select("quest_id", F.col("r").alias("v"))).groupBy("quest_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        zero = F.lit(0).cast("long")
        rows = df.join(n, "quest_id", "left").select(*df.columns, F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"))
        return rows.withColumn("passed", F.col("errors") == 0)

    def mended(df: DataFrame, name: str) -> DataFrame:
        """df (cols) with r repaired and its changes added."""
        made = repair(df.select("quest_id", "ord", F.col("r").alias("v")), entity, schema, fold).select("quest_id", F.col("r").alias("new"), F.col("changes").alias("more"))
        rows = df.join(made, "quest_id").select("quest_id", "own", "ord", "v", preserving(F.col("v"), F.col("new")).alias("r"), "attempts", F.concat("changes", "more").alias("changes"))
        return keep(rows, name)

    none = F.expr("cast(array() as array<struct<code: string, path: string, before: string, after: string>>)")
    cols = ("quest_id", "own", "ord", "v", "r", "attempts", "changes")
    # Gates and rules go by a name that is each row's own: artifacts that share an id are judged and repaired apart.
    row = F.to_json(F.struct(*[c for c in ("quest_id", "file", "ord") if c in artifacts.columns]))
    named = artifacts.select(row.alias("quest_id"), F.col("quest_id").alias("own"), "ord", "v", F.col("v").alias("r"), F.lit(0).alias("attempts"), none.alias("changes"))
    first = keep(judged(named), "judged")
    done = [first.where("passed").withColumn("repaired", F.lit(False))]
    left = keep(judged(mended(first.where("not passed").select(*cols), "mended")), "repaired")
    done.append(left.where("passed").withColumn("repaired", F.lit(True)))
    left = left.where("not passed")
    for n in range(1, attempts + 1 if responses is not None else 1):
        answer = responses.where(F.col("attempt") == n).select(F.col("quest_id").alias("own"), quest_object(recover(F.col("response"))).alias("answer"))
        tried = left.join(answer, "own", "left").withColumn("attempts", F.lit(n))
        taken = tried.where("answer is not null").select("quest_id", "own", "ord", "v", preserving(F.col("v"), F.col("answer")).alias("r"), "attempts", "changes")
        left = keep(union([judged(mended(taken, f"mended{n}")), tried.where("answer is null").select(*cols, "errors", "warnings", "passed")]), f"round{n}")
        done.append(left.where("passed").withColumn("repaired", F.lit(True)))
        left = left.where("not passed")
    records = union([*done, left.withColumn("repaired", F.lit(False))])
    return records.drop("quest_id").withColumnRenamed("own", "quest_id").select("quest_id", *[c for c in records.columns if c not in ("quest_id", "own")])


def quest_object(v: Column) -> Column:
    """The artifact of a parsed response: an object with a quest_id, the one at quest, or the only one at quests."""
    inner, listed = at(v, "quest"), at(v, "quests")
    one = F.when((kind(listed) == "ARRAY") & (F.size(elements(listed)) == 1), F.try_element_at(elements(listed), F.lit(1)))
    return F.when(is_object(v) & at(v, "quest_id").isNotNull(), v).when(is_object(inner), inner).when(is_object(one), one)


def routed(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted and rejected artifacts (quest_id, ord, v as they end), and records without the artifacts."""
    out = records.select("quest_id", "ord", F.col("r").alias("v"), "passed")
    return out.where("passed").drop("passed"), out.where("not passed").drop("passed"), records.drop("v", "r")


def change_rows(records: DataFrame) -> DataFrame:
    return records.select("quest_id", F.posexplode("changes").alias("seq", "c")).select("quest_id", "seq", "c.*")


def repair_summary(records: DataFrame) -> DataFrame:
    """One row: total, valid before and in the end, their rates over all artifacts, attempted, repaired, failed, success rate,
    deterministic repairs, response rounds, mean errors and warnings in the end; rates are 0 where nothing is counted."""
    valid = (F.col("attempts") == 0) & ~F.col("repaired") & F.col("passed")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    sums = records.agg(
        F.count("*").alias("total"), F.count_if(valid).alias("initially_valid"), F.count_if("passed").alias("valid"), F.count_if(~valid).alias("repair_attempted"), F.count_if("repaired").alias("repaired"),
        F.count_if(~F.col("passed")).alias("repair_failed"), F.count_if(F.col("repaired") & (F.col("attempts") == 0)).alias("deterministic_only"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("response_rounds"),
        F.coalesce(F.avg("errors"), F.lit(0.0)).alias("avg_errors"), F.coalesce(F.avg("warnings"), F.lit(0.0)).alias("avg_warnings"),
    )
    return sums.select("*", ratio("initially_valid", "total").alias("initial_rate"), ratio("valid", "total").alias("validity_rate"), ratio("repaired", "repair_attempted").alias("repair_success_rate"))
