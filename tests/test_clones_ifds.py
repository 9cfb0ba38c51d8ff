"""Near-miss clones and interprocedural facts against brute force."""

import random

from millrace.operators import clones, ifds


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def test_edit_distance():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        for most in (0, 2, 9):
            want = distance(a, b)
            assert clones.edit_distance(a, b, most) == (want if want <= most else None)


def test_near_sequences(spark):
    r = random.Random(7)
    base = [[r.choice("abcdefghij") for _ in range(r.randint(3, 25))] for _ in range(8)]
    rows = []
    for i in range(70):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abcxyz")
        rows.append((i, t))
    rows += [(70, []), (71, []), (72, rows[3][1])]
    got = {g.id: (g.first, g.links, g.cluster) for g in clones.near_sequences(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.8).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(tuple(t), i)
    kinds = list(first)
    near = {(a, b) for a in kinds for b in kinds if a != b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12}
    group = {k: k for k in kinds}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in near:
        group[top(a)] = top(b)
    least = {}
    for k in kinds:
        least[top(k)] = min(least.get(top(k), 10**9), first[k])
    assert got == {i: (first[tuple(t)], sum(a == tuple(t) for a, _ in near), least[top(tuple(t))]) for i, t in rows}


def test_facts_along_valid_ways_only(spark):
    """main calls id twice with different facts; neither comes back at the other's site."""
    flow = spark.createDataFrame([("m0", "a", "c1", "a"), ("m0", "b", "c2", "b"), ("i0", "p", "i1", "p"), ("i0", "q", "i1", "q"), ("r1", "a2", "end", "a2"), ("r2", "b2", "end", "b2")], "node string, fact string, to_node string, to_fact string")
    calls = spark.createDataFrame([("c1", "a", "i0", "p"), ("c2", "b", "i0", "p"), ("c2", "z", "i0", "q")], "site string, fact string, entry string, entry_fact string")
    returns = spark.createDataFrame([("i1", "p", "c1", "r1", "a2"), ("i1", "p", "c2", "r2", "b2"), ("i1", "q", "c1", "r1", "wrong")], "exit string, fact string, site string, to_node string, to_fact string")
    seeds = spark.createDataFrame([("m0", "a")], "node string, fact string")
    got = {(h.node, h.fact) for h in ifds.holding(ifds.path_edges(flow, calls, returns, seeds)).collect()}
    assert got == {("m0", "a"), ("c1", "a"), ("i0", "p"), ("i1", "p"), ("r1", "a2"), ("end", "a2")}


def test_recursion_ends(spark):
    flow = spark.createDataFrame([("f0", "x", "fc", "x"), ("f0", "x", "f1", "x"), ("fr", "x", "f1", "x")], "node string, fact string, to_node string, to_fact string")
    calls = spark.createDataFrame([("fc", "x", "f0", "x")], "site string, fact string, entry string, entry_fact string")
    returns = spark.createDataFrame([("f1", "x", "fc", "fr", "x")], "exit string, fact string, site string, to_node string, to_fact string")
    got = ifds.holding(ifds.path_edges(flow, calls, returns, spark.createDataFrame([("f0", "x")], "node string, fact string"))).collect()
    assert {h.node for h in got} == {"f0", "fc", "f1", "fr"}
