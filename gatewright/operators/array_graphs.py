"""Dependency graphs of artifacts given as arrays of edges, judged a batch at a time by Arrow functions.

A node is a bit of a word, in the order of an artifact's nodes; the closure of all graphs of a batch takes as many steps as the largest has
nodes. Graphs of more nodes than a word has bits are walked one by one (long_graphs).
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from .long_graphs import Graph

BITS = 64


class Batch:
    """Graphs of a batch: a row, a source and a target for each edge, as places among the row's own nodes in order; values: the nodes."""

    def __init__(self, edges: pa.ListArray) -> None:
        self.rows = len(edges)
        flat = edges.flatten()
        row = np.repeat(np.arange(self.rows), pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False))
        ends = [flat.field(k) for k in ("src", "dst")]
        there = pc.and_(ends[0].is_valid(), ends[1].is_valid()).to_numpy(zero_copy_only=False)
        self.row = row[there]
        code = pa.concat_arrays([e.filter(pa.array(there)) for e in ends]).dictionary_encode()
        order = pc.sort_indices(code.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.named = code.dictionary.take(pa.array(order)).to_pylist()
        key = np.concatenate([self.row, self.row]) * max(1, len(order)) + rank[code.indices.to_numpy()]
        known, at = np.unique(key, return_inverse=True)
        self.node, of = known % max(1, len(order)), known // max(1, len(order))
        self.n = np.bincount(of, minlength=self.rows)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64) if self.rows else np.zeros(0, np.int64)
        self.src, self.dst = np.split(at - self.start[np.concatenate([self.row, self.row])], 2)
        self.wide = self.n > BITS
        self.closure = self._closed()

    def _closed(self) -> np.ndarray:
        """For each row and node the nodes that it leads to, as bits."""
        few = ~self.wide[self.row]
        out = np.zeros((self.rows, int(self.n[~self.wide].max(initial=0))), np.uint64)
        np.bitwise_or.at(out, (self.row[few], self.src[few]), np.uint64(1) << self.dst[few].astype(np.uint64))
        for k in range(out.shape[1]):
            out |= ((out >> np.uint64(k)) & np.uint64(1)) * out[:, k : k + 1]
        return out

    def value(self, row: int, place: int) -> Any:
        return self.named[self.node[self.start[row] + place]]

    def pairs(self, row: int) -> list[tuple[int, int]]:
        a, b = np.searchsorted(self.row, [row, row + 1])
        return list(zip(self.src[a:b].tolist(), self.dst[a:b].tolist()))

    def graph(self, row: int) -> Graph:
        return Graph(list(range(self.n[row])), self.pairs(row))

    def around(self) -> np.ndarray:
        """For each edge, whether it is part of a cycle."""
        out, few = np.zeros(len(self.row), bool), ~self.wide[self.row]
        out[few] = (self.closure[self.row[few], self.dst[few]] >> self.src[few].astype(np.uint64)) & np.uint64(1)
        for r in np.flatnonzero(self.wide):
            g = self.graph(r)
            core = g.peeled(g.after, g.before) & g.peeled(g.before, g.after)
            mine = self.row == r
            out[mine] = [a in core and b in core for a, b in zip(self.src[mine].tolist(), self.dst[mine].tolist())]
        return out


def cyclic_rows(edges: pa.Array) -> np.ndarray:
    b = Batch(edges)
    return np.bincount(b.row[b.around()], minlength=b.rows) > 0


def simple_cycles(after: dict[int, list[int]], most: int) -> list[tuple[int, ...]]:
    """The first simple cycles, shorter ones first, then by their nodes; each starts at its least node.

    Paths grow by one node a round, to greater nodes than their first only, in order; there are no more rounds once enough are closed."""
    paths, out = [(x,) for x in sorted(after)], []
    while paths and len(out) < most:
        out += [p for p in paths if p[0] in after[p[-1]]]
        paths = [(*p, y) for p in paths for y in after[p[-1]] if y > p[0] and y not in p]
    return out[:most]


def cycle_rows(edges: pa.Array, most: int) -> list[list[list[Any]]]:
    b = Batch(edges)
    inside = b.around()
    after: dict[int, dict[int, list[int]]] = {}
    some = np.lexsort((b.dst[inside], b.row[inside]))
    for r, x, y in zip(*(c[inside][some].tolist() for c in (b.row, b.src, b.dst))):
        nexts = after.setdefault(r, {}).setdefault(x, [])
        if not nexts or nexts[-1] != y:
            nexts.append(y)
    out: list[list[list[Any]]] = [[] for _ in range(b.rows)]
    for r, links in after.items():
        if b.wide[r]:
            for y in {y for ys in links.values() for y in ys}:
                links.setdefault(y, [])
        out[r] = [[b.value(r, x) for x in c] for c in simple_cycles(links, most)]
    return out


def lost_rows(edges: pa.Array) -> list[list[Any]]:
    """Nodes that no node without a predecessor leads to."""
    b = Batch(edges)
    few = ~b.wide[b.row]
    led = np.zeros(b.rows, np.uint64)
    np.bitwise_or.at(led, b.row[few], np.uint64(1) << b.dst[few].astype(np.uint64))
    found = ~led
    for k in range(b.closure.shape[1]):
        found |= ((~led >> np.uint64(k)) & np.uint64(1)) * b.closure[:, k]
    out: list[list[Any]] = [[] for _ in range(b.rows)]
    for r in np.flatnonzero(~found & led):
        out[r] = [b.value(r, x) for x in range(b.n[r]) if not int(found[r]) >> x & 1]
    for r in np.flatnonzero(b.wide):
        g = b.graph(r)
        seen = g.reached(g.roots())
        out[r] = [b.value(r, x) for x in g.nodes if x not in seen]
    return out


@F.arrow_udf(BooleanType())
def _cyclic(edges: pa.Array) -> pa.Array:
    return pa.array(cyclic_rows(edges))


def _as(edges: Column, named: bool) -> Column:
    return edges.cast(f"array<struct<src: {'string' if named else 'long'}, dst: {'string' if named else 'long'}>>")


def cyclic(edges: Column, named: bool = False) -> Column:
    """Whether edges (array of src, dst; texts where named) have a cycle."""
    return _cyclic(_as(edges, named))


def first_cycles(edges: Column, most: int, named: bool = False) -> Column:
    """See simple_cycles; none for a graph without."""
    def run(edges: pa.Array) -> pa.Array:
        return pa.array(cycle_rows(edges, most), pa.list_(pa.list_(pa.string() if named else pa.int64())))

    run.__annotations__ = {"edges": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<array<{'string' if named else 'long'}>>")(_as(edges, named))


def unreached(edges: Column, named: bool = False) -> Column:
    """Nodes of edges that no root leads to."""
    def run(edges: pa.Array) -> pa.Array:
        return pa.array(lost_rows(edges), pa.list_(pa.string() if named else pa.int64()))

    run.__annotations__ = {"edges": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<{'string' if named else 'long'}>")(_as(edges, named))


@F.arrow_udf(LongType())
def absent(deps: pa.Array, names: pa.Array) -> pa.Array:
    """How many of deps (texts) are not among names; nulls count. Null where deps are."""
    out = []
    for d, n in zip(deps, names):
        known = set(n.as_py()) if d.is_valid else set()
        out.append(sum(x is None or x not in known for x in d.as_py()) if d.is_valid else None)
    return pa.array(out, pa.int64())
