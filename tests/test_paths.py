"""Counts and lists of ways against plain walks on random graphs."""

import random
from collections import Counter

from millrace.operators import paths


def test_walks_and_simple_paths(spark):
    random.seed(6)
    graphs = {f: [(random.randrange(6), random.randrange(6)) for _ in range(10)] for f in range(25)}
    edges = spark.createDataFrame([(f, a, b) for f, es in graphs.items() for a, b in es], "func int, src int, dst int")
    sources = spark.createDataFrame([(f, b) for f in graphs for b in (0, 1)], "func int, block int")
    targets = spark.createDataFrame([(f, b) for f in graphs for b in (1, 4, 5)], "func int, block int")
    walks, simple = Counter(), Counter()
    for f, es in graphs.items():
        level = [(0,), (1,)]
        for length in range(5):
            for w in level:
                walks[f, w[-1], length] += 1
                simple[f, w] += w[-1] in (1, 4, 5) and len(set(w)) == len(w)
            level = [(*w, b) for w in level for a, b in set(es) if a == w[-1]]
    got = {(r.func, r.block, r.length): int(r.walks) for r in paths.walk_counts(edges, sources, 4).collect()}
    assert got == dict(walks)
    found = Counter((r.func, tuple(r.path)) for r in paths.simple_paths(edges, sources, targets, 4).collect())
    assert found == +simple
    per_end = Counter((f, w[-1], len(w) - 1) for f, w in found)
    assert all(n <= walks[k] for k, n in per_end.items())


def test_nothing_leads_there(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "func int, src int, dst int")
    place = lambda b: spark.createDataFrame([(1, b)], "func int, block int")
    assert paths.simple_paths(edges, place(1), place(9), 5).collect() == []
    assert [r.path for r in paths.simple_paths(edges, place(1), place(1), 5).collect()] == [[1]]
