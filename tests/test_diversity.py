"""Similarity and set metrics of all artifacts against brute force over all pairs."""

import math
from collections import Counter
from itertools import combinations

import pytest

from gatewright.operators import diversity
from gatewright.plans import catalog
from gatewright.sources.views import from_tables

SF = "/root/testdata/sf0.001"


def test_similarity_and_set_metrics_of_all_artifacts(spark):
    v = from_tables(spark, SF)
    sigs = [r.signature for r in diversity.signatures(v).collect()]
    sets = [frozenset(s.split(" -> ")) for s in sigs]
    mean = sum(len(a & b) / len(a | b) for a, b in combinations(sets, 2)) / math.comb(len(sets), 2)
    [row] = catalog.QUERIES["q_pairwise_similarity"](spark, SF).collect()
    assert row.similarity == pytest.approx(mean, abs=1e-6)
    [m] = catalog.QUERIES["q_set_metrics"](spark, SF).collect()
    kinds = Counter(r.quest_type for r in v.artifact.collect())
    n, of = sum(kinds.values()), Counter(sigs)
    uses = Counter(r.entity_id for r in diversity.references(v).collect())
    assert (m.quest_count, m.unique_signatures) == (n, len(of))
    assert m.entropy == pytest.approx(-sum(c / n * math.log(c / n) for c in kinds.values()) / math.log(len(kinds)), abs=1e-6)
    assert m.duplicate_rate == pytest.approx(sum(c for c in of.values() if c > 1) / n, abs=1e-6)
    assert m.coverage == pytest.approx(len(uses) / v.entity.count(), abs=1e-6)
    assert m.concentration == pytest.approx(max(uses.values()) / sum(uses.values()), abs=1e-6)
    assert m.similarity == pytest.approx(mean, abs=1e-6)
