"""Dependency graphs of long artifacts, in time linear in their steps.

Expressions over arrays go over all edges once for each node, which suits artifacts of some steps. An artifact of more nodes than LONG is
taken by an Arrow function instead: a row is one artifact, so tasks hold one graph at a time, and results are those of the expressions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Nodes up to which expressions judge a graph.
LONG = 200


def in_order(nodes: Iterable[Any]) -> list[Any]:
    """Nodes in order; a dependency that is null is a node too, and the last."""
    return sorted(nodes, key=lambda x: (x is None, x))


class Graph:
    def __init__(self, nodes: list[Any], edges: list[tuple[Any, Any]]) -> None:
        self.nodes, self.edges = nodes, edges
        self.after: dict[Any, list[Any]] = {x: [] for x in nodes}
        self.before: dict[Any, list[Any]] = {x: [] for x in nodes}
        for a, b in edges:
            self.after[a].append(b)
            self.before[b].append(a)

    def peeled(self, after: dict[Any, list[Any]], before: dict[Any, list[Any]]) -> set[Any]:
        """Nodes that are left once those are gone that nothing leads to, again and again."""
        waits = {x: len(before[x]) for x in self.nodes}
        free, left = deque(x for x in self.nodes if not waits[x]), set(self.nodes)
        while free:
            x = free.popleft()
            left.discard(x)
            for y in after[x]:
                waits[y] -= 1
                if not waits[y]:
                    free.append(y)
        return left

    def cyclic(self) -> bool:
        return bool(self.peeled(self.after, self.before))

    def roots(self) -> list[Any]:
        return in_order(x for x in self.nodes if not self.before[x])

    def terminals(self) -> list[Any]:
        return in_order(x for x in self.nodes if not self.after[x])

    def reached(self, starts: list[Any], within: set[Any] | None = None) -> dict[Any, int]:
        """Nodes that starts lead to, with their distances."""
        at = dict.fromkeys(starts, 0)
        queue = deque(at)
        while queue:
            x = queue.popleft()
            for y in self.after[x]:
                if y not in at and (within is None or y in within):
                    at[y] = at[x] + 1
                    queue.append(y)
        return at

    def components(self) -> int:
        seen: set[Any] = set()
        n = 0
        for x in self.nodes:
            if x not in seen:
                n += 1
                seen.add(x)
                stack = [x]
                while stack:
                    y = stack.pop()
                    for z in (*self.after[y], *self.before[y]):
                        if z not in seen:
                            seen.add(z)
                            stack.append(z)
        return n

    def degree(self) -> int:
        return max((len(self.after[x]) + len(self.before[x]) for x in self.nodes), default=0)

    def shortest_cycles(self, most: int, looks: int = 200) -> list[list[Any]]:
        """Cycles through the least nodes that lie between cycles: of each the shortest that goes over greater nodes only.

        Long artifacts may have more cycles than can be listed; these are found with a search for each node, of looks nodes at most."""
        core = self.peeled(self.after, self.before) & self.peeled(self.before, self.after)
        out = []
        for x in sorted(core)[:looks]:
            came, queue = {x: None}, deque([x])
            while queue and len(out) < most:
                y = queue.popleft()
                if x in self.after[y]:
                    path = [y]
                    while came[path[-1]] is not None:
                        path.append(came[path[-1]])
                    out.append(path[::-1])
                    break
                for z in sorted(self.after[y]):
                    if z in core and z > x and z not in came:
                        came[z] = y
                        queue.append(z)
        return sorted(out, key=lambda c: (len(c), c))


def graphs(batch: pa.RecordBatch) -> Iterator[tuple[Any, Graph]]:
    for key, nodes, edges in zip(*(batch[c].to_pylist() for c in ("quest_id", "nodes", "edges"))):
        yield key, Graph(nodes, [(e["src"], e["dst"]) for e in edges])


def applied(rows: DataFrame, schema: StructType, of: Any) -> DataFrame:
    """rows (quest_id, nodes, edges) with what of makes of each graph: a dict of the schema's other columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"quest_id": key, "nodes": g.nodes, "edges": [{"src": a, "dst": b} for a, b in g.edges], **of(g)} for key, g in graphs(batch)]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in arrow.names} for r in out], schema=arrow)

    return rows.select("quest_id", "nodes", "edges").mapInArrow(run, schema)


def facts(g: Graph) -> dict[str, Any]:
    """As gates.graph_facts has them."""
    cyclic = g.cyclic()
    return {"cyclic": cyclic, "n_nodes": len(g.nodes), "n_edges": len(g.edges), "roots": None if cyclic else g.roots(), "terminals": None if cyclic else g.terminals()}


def measures(g: Graph) -> dict[str, Any]:
    """As gates.graph_metrics has them."""
    n, m = len(g.nodes), len(g.edges)
    return {
        "n_nodes": n, "n_edges": m, "density": m / (n * (n - 1)) if n > 1 else 0.0, "components": g.components(),
        "max_depth": max(g.reached(g.roots()).values(), default=0), "max_degree_centrality": g.degree() / (n - 1) if n > 1 else 0.0,
    }
