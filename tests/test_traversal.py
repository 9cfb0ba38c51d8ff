"""Traversals on a small labelled graph."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import traversal as tr


@pytest.fixture(scope="module")
def g(spark):
    nodes = [(1, "def", "x", "x", 0), (2, "use", "x", "x", 0), (3, "call", "f", None, 0), (4, "entry", "f", None, 1), (5, "use", "y", "y", 1), (6, "lit", "0", None, 1)]
    edges = [(1, 2, "ddg", "x"), (2, 3, "cfg", "next"), (3, 4, "call", "f"), (4, 5, "cfg", "next"), (2, 5, "ddg", "x.y"), (5, 1, "cfg", "back")]
    return tr.Graph(spark.createDataFrame(nodes, "node int, kind string, name string, var string, proc int"), spark.createDataFrame(edges, "src int, dst int, family string, label string"))


def at(g, traversal, *start):
    s = g.nodes.where(F.col("node").isin(*start)).select("node")
    return sorted(r.node for r in traversal(g, s).collect())


def test_steps_and_sets(g):
    assert at(g, tr.out(), 2) == [3, 5] and at(g, tr.into(), 5) == [2, 4]
    assert at(g, tr.out(tr.family("ddg")), 2) == [5] and at(g, tr.out(tr.prefix("x") & ~tr.exact("x")), 1, 2) == [5]
    assert at(g, tr.out() | tr.into(), 2) == [1, 3, 5] and at(g, tr.out() & tr.out(tr.family("cfg")), 2) == [3]
    assert at(g, tr.out() - tr.out(tr.family("cfg")), 2) == [5] and at(g, tr.out() ^ tr.into(), 5) == [1, 2, 4]
    assert at(g, ~tr.out(), 2) == [1, 2, 4, 6] and at(g, tr.EMPTY, 1) == [] and at(g, tr.IDENTITY, 1) == [1] and len(at(g, tr.EVERYTHING, 1)) == 6


def test_composition_laws(g):
    a, b, c = tr.out(), tr.into(), tr.where("kind != 'lit'")
    for start in (1, 2, 5):
        assert at(g, a.then(b).then(c), start) == at(g, a.then(b.then(c)), start) == at(g, a.then(b, c), start)
        assert at(g, (a | b).then(c), start) == at(g, a.then(c) | b.then(c), start)
        assert at(g, tr.IDENTITY.then(a), start) == at(g, a, start)


def test_closures(g):
    assert at(g, tr.closure(), 1) == [1, 2, 3, 4, 5] and at(g, tr.closure(depth=1), 1) == [1, 2]
    assert at(g, tr.dependence_slice(), 5) == [1, 2, 5] and at(g, tr.dependence_slice(False), 1) == [1, 2, 5]
    assert at(g, tr.EVERYTHING.then(tr.uses_of("x")), 1) == [2] and at(g, tr.EVERYTHING.then(tr.definitions_of("x")), 2) == [1]
    pairs = [(a, b) for a in range(1, 7) for b in range(1, 7)]
    ahead = {a: at(g, tr.closure(), a) for a in range(1, 7)}
    back = {b: at(g, tr.closure(backward=True), b) for b in range(1, 7)}
    assert all((b in ahead[a]) == (a in back[b]) for a, b in pairs)
    assert sorted(r.node for r in tr.two_phase_backward_slice(g, g.nodes.where("node = 5").select("node")).collect()) == [1, 2, 5]


def test_well_formed(g, spark):
    assert g.well_formed().count() == 0
    bad = tr.Graph(g.nodes.unionByName(g.nodes.where("node = 1")), g.edges.unionByName(spark.createDataFrame([(99, 1, "cfg", "x")], g.edges.schema)))
    assert {r.problem: r.n for r in bad.well_formed().collect()} == {"repeated_node": 1, "unknown_src": 1}
