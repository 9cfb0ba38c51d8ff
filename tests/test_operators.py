"""Hand-built cases of graphs, dataflow, metrics, deltas and vectors."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions import vectors as vx
from millrace.operators import dataflow, graph, incremental, measures, nearest
from millrace.operators.components import connected_components


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def one(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def drawn(seed, nodes=14, n=22):
    """A random graph, loops and repeats left out."""
    r = random.Random(seed)
    pairs = {(f"k{r.randrange(nodes):02}", f"k{r.randrange(nodes):02}") for _ in range(n)}
    return sorted(p for p in pairs if p[0] != p[1])


def walked(pairs, start, depth=None):
    """Breadth first: what ``start`` reaches and how far it is."""
    found, ring, far = {start: 0}, {start}, 0
    while ring and far != depth:
        far += 1
        ring = {b for a, b in pairs if a in ring} - found.keys()
        found |= dict.fromkeys(ring, far)
    return found


@pytest.mark.parametrize("depth", [None, 0, 1, 2])
@pytest.mark.parametrize("backward", [False, True])
def test_reach_of_random_graphs(spark, depth, backward):
    pairs = drawn(5)
    turned = [(b, a) for a, b in pairs] if backward else pairs
    got = graph.reach(edges(spark, *pairs), one(spark, "k03"), depth, backward=backward).collect()
    assert {r.node: r.distance for r in got} == walked(turned, "k03", depth)


def test_reach_of_a_node_without_edges(spark):
    assert [r.node for r in graph.reach(edges(spark, *drawn(5)), one(spark, "elsewhere")).collect()] == ["elsewhere"]


def test_roles_and_layers_of_random_graphs(spark):
    pairs = [(min(p), max(p)) for p in drawn(6)]  # no cycles
    ins, outs = {b for _, b in pairs}, {a for a, _ in pairs}
    want = {n: "entry" if n not in ins else "leaf" if n not in outs else "middle" for n in ins | outs}
    assert {r.node: r.role for r in graph.roles(edges(spark, *pairs)).collect()} == want
    level = {}
    for n in sorted(ins | outs):
        level[n] = max((level[a] + 1 for a, b in pairs if b == n), default=0)
    assert {r.node: r.layer for r in graph.layers(edges(spark, *pairs)).collect()} == level
    assert graph.layers(edges(spark, ("p", "q"), ("q", "r"), ("r", "p"))).count() == 0


@pytest.mark.parametrize("pairs,want", [
    ((("A", "B"), ("B", "C"), ("C", "A")), [3]),
    ((("A", "B"), ("B", "C")), [1, 1, 1]),
    ((("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c")), [2, 2]),
    ((("s", "s"),), [1]),
])
def test_strong_components(spark, pairs, want):
    found = graph.strong_components(edges(spark, *pairs))
    assert sorted(r["count"] for r in found.groupBy("component").count().collect()) == want


def test_chop(spark):
    e = edges(spark, ("1", "2"), ("1", "4"), ("2", "3"), ("3", "4"), ("4", "5"))
    assert sorted(r.node for r in graph.chop(e, one(spark, "1"), one(spark, "5")).collect()) == list("12345")
    assert sorted(r.node for r in graph.chop(e, one(spark, "2"), one(spark, "4")).collect()) == list("234")
    assert graph.chop(e, one(spark, "5"), one(spark, "1")).count() == 0


def test_sanitized_ways_do_not_count(spark):
    e = edges(spark, ("in", "check"), ("check", "db"), ("in", "raw"), ("raw", "log"))
    got = graph.unsanitized(e, one(spark, "in"), one(spark, "db", "log"), one(spark, "check"))
    assert [r.node for r in got.collect()] == ["log"]


def test_connected_components(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (5, 5), (None, 7)] + [(100 + i, 101 + i) for i in range(40)]
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(found) == len(roots) and {roots[0], roots[1], roots[2]} == {0} and roots[4] == 3 and roots[140] == 100 and 5 not in roots
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


LOOP = [("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 1, 3)]


def facts(spark, *rows):
    return spark.createDataFrame([("f", b, x) for b, x in rows], "func string, block int, fact string")


def flow(spark, rows=LOOP):
    return spark.createDataFrame(rows, "func string, src int, dst int")


def pairs_of(df):
    return sorted((r.block, r.fact) for r in df.collect())


def test_reaching_definitions_in_a_loop(spark):
    gen, kill = facts(spark, (0, "i0"), (2, "i2")), facts(spark, (0, "i2"), (2, "i0"))
    assert pairs_of(dataflow.may_forward(flow(spark), gen, kill)) == [(1, "i0"), (1, "i2"), (2, "i0"), (2, "i2"), (3, "i0"), (3, "i2")]


def test_live_variables_in_a_loop(spark):
    """Backward: a variable is live after block b if it is used later before it is set."""
    use, define = facts(spark, (1, "n"), (1, "i"), (2, "i"), (3, "x")), facts(spark, (0, "i"), (2, "x"))
    live_out = dataflow.may_forward(dataflow.flipped(flow(spark)), use, define)
    assert pairs_of(live_out) == [(0, "i"), (0, "n"), (0, "x"), (1, "i"), (1, "n"), (1, "x"), (2, "i"), (2, "n"), (2, "x")]


def test_available_and_busy_expressions(spark):
    branch = [("f", 0, 1), ("f", 1, 2), ("f", 1, 3), ("f", 2, 4), ("f", 3, 4)]
    blocks = spark.createDataFrame([("f", b) for b in range(5)], "func string, block int")
    both, half = facts(spark, (2, "a+b"), (3, "a+b")), facts(spark, (2, "a+b"))
    none = facts(spark, (9, "none")).limit(0)
    assert pairs_of(dataflow.must_forward(flow(spark, branch), both, none, blocks)) == [(4, "a+b")]
    assert pairs_of(dataflow.must_forward(flow(spark, branch), half, none, blocks)) == []
    busy = dataflow.must_forward(dataflow.flipped(flow(spark, branch)), both, none, blocks)
    assert (1, "a+b") in pairs_of(busy)


def test_must_analysis_with_a_kill_on_the_back_edge(spark):
    blocks = spark.createDataFrame([("f", b) for b in range(4)], "func string, block int")
    got = dataflow.must_forward(flow(spark), facts(spark, (0, "e")), facts(spark, (2, "e")), blocks)
    assert pairs_of(got) == []
    got = dataflow.must_forward(flow(spark), facts(spark, (0, "e")), facts(spark, (3, "e")), blocks)
    assert pairs_of(got) == [(1, "e"), (2, "e"), (3, "e")]


def test_stats_bands_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1, 5, 10, 15, 20)], "v long")
    row = measures.integer_stats(df, "v").first()
    assert (row.n, row.least, row.most, row.median) == (5, 1, 20, 10)
    bands = spark.createDataFrame([(v,) for v in (10, 11, 20, 21, 50, 51)], "v long").select(measures.risk_band(F.col("v")).alias("b")).collect()
    assert [r.b for r in bands] == ["low", "medium", "medium", "high", "high", "critical"]
    assert [r.n for r in measures.histogram(df, "v", 5, 3).orderBy("bucket").collect()] == [2, 1, 2]


def test_halstead(spark):
    made = measures.halstead(*(F.lit(x) for x in (5, 4, 10, 8)))
    row = spark.range(1).select(made["volume"].alias("v"), made["difficulty"].alias("d")).first()
    assert (row.v, row.d) == (57.0587, 5.0)


def test_cohesion(spark):
    uses = [("c", "m1", "x"), ("c", "m1", "y"), ("c", "m2", "y"), ("c", "m3", "z"), ("c", "m4", "z")]
    row = measures.lack_of_cohesion(spark.createDataFrame(uses, "owner string, method string, attribute string")).first()
    assert (row.methods, row.lcom1, row.lcom2) == (4, 2, 2)


def test_tokens_and_words(spark):
    df = spark.createDataFrame([("hello world",), ("",), ("a",), ("parseHTTPRequest_v2",)], "t string")
    rows = df.select(tx.estimated_tokens("t").alias("n"), tx.word_parts("t").alias("w"), tx.lines("t").alias("l")).collect()
    assert [r.n for r in rows[:3]] == [2, 0, 1] and rows[3].w == ["parse", "http", "request", "v2"] and [r.l for r in rows[:3]] == [1, 0, 1]


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(vx.cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0]
    assert [r.d for r in df.select(F.round(vx.euclidean("a", "b"), 3).alias("d")).collect()] == [0.0, 1.414, 1.0]


def test_nearest_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ITEMS", 7)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    items = spark.range(50).select("id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    got = nearest.cosine_top_k(items, items.where("id % 10 = 0"), 3).collect()
    import math

    for q in range(0, 50, 10):
        want = sorted((i for i in range(50) if i != q), key=lambda i: (-round(math.cos(i - q), 6), i))[:3]
        assert [r.id for r in sorted((g for g in got if g.query == q), key=lambda g: g.rank)] == want


def test_incremental(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    assert {r.k: r.state for r in incremental.classify(old, new, "k", "v").collect()} == {1: "unchanged", 2: "changed", 3: "deleted", 4: "added"}
    assert sorted(map(tuple, incremental.apply_delta(old, new.where("k in (2, 4)"), old.where("k = 3"), "k").collect())) == sorted(map(tuple, new.collect()))


def test_components_of_a_long_chain(spark):
    """Round numbers do not grow with the length of a chain, and a hub costs no more than its leaves."""
    pairs = [(i, i + 1) for i in range(1000)] + [(2000, 2001 + i) for i in range(500)]
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1001)} | {(i, 2000) for i in range(2000, 2501)}
