"""Diversity-aware repair: an ordered fold over the artifacts of a set, whose choices depend on what came before.

The fold keeps how often signatures, their components and entities have been used, by artifacts that are valid from the start (seeds) and by those
repaired so far. It keeps a known target and changes the action, replaces entities by the least used ones that suit, and puts support
objectives first that make rare signatures. Each choice is the least of a tuple, so reruns agree. Sets are folded apart
(applyInPandas, one task for each set, artifacts in their order): the order is the semantics here, so a set cannot be split; everything
else of the repair is the deterministic one's, over all rows. The catalog is sent to the tasks, up to MAX_ENTITIES entities; more are an error.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import Views
from .diversity import references, signatures
from .repair import ACTION_TYPES, CONDITIONS, OTHER_CONDITION, TYPE_ACTION, constraint, enumeration

MAX_ENTITIES = 100_000
#: Actions that suit a type of target, in order; what replaces an action that does not suit; actions that suit a kind of artifact.
TYPE_ACTIONS = {
    "npc": ("talk", "rescue", "escort", "protect", "interact", "return"),
    "location": ("visit", "travel", "investigate", "protect", "return"),
    "item": ("collect", "use", "inspect", "investigate", "interact"),
    "object": ("inspect", "interact", "use", "unlock", "investigate", "collect"),
    "enemy": ("defeat",),
    "faction": ("interact",),
}
DIRECT = {
    ("visit", "npc"): "talk",
    ("visit", "item"): "inspect",
    ("visit", "object"): "inspect",
    ("travel", "npc"): "talk",
    ("travel", "item"): "collect",
    ("travel", "object"): "inspect",
    ("collect", "npc"): "talk",
    ("collect", "location"): "investigate",
    ("defeat", "object"): "interact",
    ("defeat", "location"): "investigate",
}
KIND_ACTIONS = {
    "dialogue": ("talk", "interact", "return"),
    "collection": ("collect", "inspect", "investigate", "return"),
    "exploration": ("investigate", "visit", "travel", "inspect", "interact"),
    "combat": ("defeat", "protect", "travel"),
    "rescue": ("rescue", "escort", "travel", "talk"),
    "delivery": ("deliver", "collect", "return", "talk"),
}
OTHER_KIND = ("investigate", "travel", "talk")


def told(action: str, target: str) -> str:
    return CONDITIONS[action].replace("{0}", target) if action in CONDITIONS else OTHER_CONDITION.replace("{0}", action).replace("{1}", target)


def suits(action: str, type_: str | None) -> bool:
    return type_ in ACTION_TYPES.get(action, ())


class Fold:
    """What has been used so far, and choices by it. Objectives are (action, target, success)."""

    def __init__(self, types: dict[str, str], actions: list[str]) -> None:
        self.types, self.actions = types, set(actions)
        self.of: dict[str, list[str]] = {}
        for e, t in types.items():
            self.of.setdefault(t, []).append(e)
        self.signatures, self.components, self.entities = Counter(), Counter(), Counter()

    def register(self, signature: str, refs: list[str], n: int = 1) -> None:
        self.signatures[signature] += n
        for c in signature.split(" -> ") if signature else []:
            self.components[c] += n
        for e in refs:
            self.entities[e] += n

    def least_used(self, *types: str, without: tuple[str, ...] = ()) -> str | None:
        return min((e for t in types for e in self.of.get(t, ()) if e not in without), key=lambda e: (self.entities[e], e), default=None)

    def action_for(self, type_: str, kind: str, action: str) -> str:
        """The action for a target that stays."""
        if suits(action, type_):
            return action
        direct = DIRECT.get((action, type_))
        if direct and suits(direct, type_):
            return direct
        preferred = KIND_ACTIONS.get(kind, ())
        rank = lambda a: preferred.index(a) if a in preferred else len(preferred) + 1
        fit = [a for a in TYPE_ACTIONS.get(type_, ()) if a in self.actions and suits(a, type_)]
        return min(fit, key=lambda a: (rank(a), self.components[f"{a}:{type_}"], a != action, a), default="interact")

    def fallback(self, kind: str, start: str) -> tuple[str, str]:
        for a in KIND_ACTIONS.get(kind, OTHER_KIND):
            if t := self.least_used(*ACTION_TYPES[a]):
                return a, t
        return "travel", start if self.types.get(start) == "location" else self.least_used("location") or "unknown_target"

    def core(self, action: str, target: str, success: str, kind: str, start: str) -> tuple[str, str, str]:
        if target in self.types:
            action = self.action_for(self.types[target], kind, action)
        else:
            other = self.least_used(*ACTION_TYPES[action]) if action in ACTION_TYPES else None
            action, target = (action, other) if other else self.fallback(kind, start)
        return action, target, success if len(success) >= 12 else told(action, target)

    def signature(self, steps: list[tuple[str, str, str]]) -> str:
        return " -> ".join(f"{a or 'unknown'}:{self.types.get(t, 'unknown')}" for a, t, _ in steps)

    def support(self, steps: list[tuple[str, str, str]], kind: str, giver: str, start: str) -> tuple[str, str, str]:
        thing = self.least_used("object")
        offers = [("talk", giver), ("travel", start), ("investigate", start), ("return", giver), ("inspect", thing), ("collect", self.least_used("item")), ("interact", thing)]
        there = {(a, t) for a, t, _ in steps}
        offers = [x for x in offers if x[1] in self.types and x not in there] or [self.fallback(kind, start)]

        def cost(x: tuple[str, str]) -> tuple[int, int, int, str, str]:
            s = self.signature([(*x, ""), *steps])
            return self.signatures[s], self.components[s.split(" -> ")[0]], self.entities[x[1]], *x

        best = min(offers, key=cost)
        return (*best, told(*best))

    def step(self, r: Any, least: int) -> dict[str, Any]:
        """What the repair of one artifact takes from the fold; registers it if its objectives suit."""
        rescued, kind = tuple(r.rescued), r.kind.lower()
        free, place, item = self.least_used("npc", without=rescued), self.least_used("location"), self.least_used("item")
        giver = free if free and (self.types.get(r.giver) != "npc" or r.giver in rescued) else r.giver
        start = place if place and self.types.get(r.start) != "location" else r.start
        steps = [self.core(s["action"], s["target"], s["success"], kind, start) for s in r.steps]
        while len(steps) < least:
            steps.insert(0, self.support(steps, kind, giver, start))
        if all(suits(a, self.types.get(t)) for a, t, _ in steps):
            goods = [x if self.types.get(x) == "item" else item for x in r.items]
            self.register(self.signature(steps), [e for e in (giver, start, *[t for _, t, _ in steps], *goods) if e in self.types])
        return {"free_npc": free, "first_location": place, "first_item": item, "chosen": [{"action": a, "target": t, "success_condition": c} for a, t, c in steps]}


CHOSEN = "quest_id string, ord long, free_npc string, first_location string, first_item string, chosen array<struct<action: string, target: string, success_condition: string>>"


def catalog(entity: DataFrame) -> dict[str, str]:
    rows = entity.select("entity_id", "entity_type").limit(MAX_ENTITIES + 1).collect()
    if len(rows) > MAX_ENTITIES:
        raise ValueError(f"more than {MAX_ENTITIES} entities: too many to send to each task of the fold")
    return dict(rows)


def seeds(valid: Views) -> DataFrame:
    """kind (signature or entity), key, n, set_id of valid artifacts: the fold's state before the first repair."""
    ids = valid.artifact.select("quest_id", "set_id")
    s = signatures(valid).join(ids, "quest_id").groupBy("set_id", F.col("signature").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("signature"))
    e = references(valid).join(ids, "quest_id").groupBy("set_id", F.col("entity_id").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("entity"))
    return s.unionByName(e)


def folded(entity: DataFrame, schema: dict[str, Any], valid: Views | None = None, set_of=None):
    """A function for repair(..., fold=): from its rows to CHOSEN. set_of: a column of the set (default: all are one)."""
    types = catalog(entity)
    actions = enumeration(schema, "properties", "objectives", "items", "properties", "action")
    least = constraint(schema, ("properties", "objectives"), "minItems", 1)
    key = F.lit(0).cast("string") if set_of is None else set_of.cast("string")

    def run(_: Any, rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        fold = Fold(types, actions)
        for s in () if before is None else before.itertuples():
            fold.register(s.key, [], s.n) if s.kind == "signature" else fold.entities.update({s.key: s.n})
        out = [{"quest_id": r.quest_id, "ord": r.ord, **fold.step(r, least)} for r in rows.sort_values(["ord", "quest_id"]).itertuples()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHOSEN.split(", ")[:5]] + ["chosen"])

    def fold(rows: DataFrame) -> DataFrame:
        goods = F.transform(F.filter("p.rewards", lambda r: r["type"] == "item"), lambda r: r["ref"])
        steps = F.transform("p.steps", lambda s: F.struct(s["action"].alias("action"), s["target"].alias("target"), s["success"].alias("success")))
        flat = rows.select(key.alias("set_key"), "quest_id", F.col("ord").cast("long").alias("ord"), F.col("kind").alias("kind"), F.col("p.giver_npc").alias("giver"), F.col("p.start_location").alias("start"), F.col("p.rescued").alias("rescued"), steps.alias("steps"), goods.alias("items"))
        if valid is None:
            return flat.groupBy("set_key").applyInPandas(lambda k, x: run(k, x), CHOSEN)
        state = seeds(valid).withColumn("set_key", F.col("set_id").cast("string") if set_of is not None else F.lit("0"))
        return flat.groupBy("set_key").cogroup(state.groupBy("set_key")).applyInPandas(lambda k, x, y: run(k, x, y), CHOSEN)

    return fold
