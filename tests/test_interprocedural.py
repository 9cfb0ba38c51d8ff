"""System dependence graphs, demand-driven facts, thin slices, labels and maintained reachability against plain walks."""

import random

from millrace.lineage import stored
from millrace.operators import dependence, ifds, incremental, sdg


def closure_of(start, step):
    seen, todo = set(), list(start)
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += step(x)
    return seen


def random_system(seed):
    """Functions of a few nodes with calls, recursive ones too: inside edges, (site, passed, taken), (site, given, received)."""
    random.seed(seed)
    n = random.randint(2, 4)
    nodes = {f: [f"{seed}{f}{k}" for k in range(6)] for f in "pqrs"[:n]}
    inside = [(a, b) for f in nodes for a, b in ((random.choice(nodes[f]), random.choice(nodes[f])) for _ in range(4))]
    into, back = [], []
    for k in range(random.randint(2, 5)):
        caller, callee, site = random.choice(list(nodes)), random.choice(list(nodes)[1:]), 100 * seed + k
        into += [(site, random.choice(nodes[caller]), nodes[callee][k]) for k in (0, 1)]
        back += [(site, nodes[callee][4 + k], random.choice(nodes[caller])) for k in (0, 1)]
    return sum(nodes.values(), []), inside, into, back


def realisable_backward(node, inside, into, back, depth=9):
    """A walk with an explicit stack of calls. In so small a system deeper stacks find nothing new."""

    def step(state):
        at, stack = state
        yield from ((a, stack) for a, b in inside if b == at)
        yield from ((fo, (*stack, s)) for s, fo, ao in back if ao == at and len(stack) < depth)
        for s, ai, fi in into:
            if fi == at:
                if not stack:
                    yield ai, stack
                elif stack[-1] == s:
                    yield ai, stack[:-1]

    return {at for at, _ in closure_of([(node, ())], lambda x: list(step(x)))}


def test_two_phase_slices_follow_realisable_ways(spark):
    systems = [random_system(seed) for seed in range(40)]
    inside, into, back = (sum((s[k] for s in systems), []) for k in (1, 2, 3))
    frames = [stored(spark.createDataFrame(rows, schema)) for rows, schema in ((inside, "src string, dst string"), (into, "site int, src string, dst string"), (back, "site int, src string, dst string"))]
    criteria = spark.createDataFrame([(n, n) for s in systems for n in s[0]], "origin string, node string")
    summary = stored(sdg.summaries(*frames))
    want = {(n, m) for nodes, *parts in systems for n in nodes for m in realisable_backward(n, *parts)}
    assert {(r.origin, r.node) for r in sdg.two_phase_slice(*frames, criteria, summary=summary).collect()} == want
    assert {(r.origin, r.node) for r in sdg.two_phase_slice(*frames, criteria, backward=False).collect()} == {(m, n) for n, m in want}
    mixed = {(n, m) for nodes, here, up, down in systems for n in nodes for m in closure_of([n], lambda x: [a for _, a, b in [(0, *e) for e in here] + up + down if b == x])}
    assert want < mixed and len(mixed) - len(want) > 20  # contexts do make a difference


def test_demanded_facts_are_those_of_the_full_run_and_fewer_rows(spark):
    random.seed(1)
    flow, calls, returns, starts, asked = [], [], [], [], []
    for s in range(12):
        place = lambda: (f"{s}{random.choice('abcdefgh')}", random.randrange(3))  # noqa: B023, E731
        flow += [(*place(), *place()) for _ in range(14)]
        calls += [(f"{s}c", f, f"{s}e", f) for f in range(3)] + [(f"{s}a", 1, f"{s}g", 2)]
        returns += [(f"{s}f", f, f"{s}c", f"{s}d", f) for f in range(3)] + [(f"{s}h", 1, f"{s}a", f"{s}b", 0)]
        starts += [(f"{s}a", 0), (f"{s}a", 1), (f"{s}b", 2)]
        asked += [(f"{s}d", 1), (f"{s}h", 0)]
    frames = [stored(spark.createDataFrame(rows, schema)) for rows, schema in ((flow, "node string, fact int, to_node string, to_fact int"), (calls, "site string, fact int, entry string, entry_fact int"), (returns, "exit string, fact int, site string, to_node string, to_fact int"))]
    seeds = spark.createDataFrame(starts, "node string, fact int")
    queries = spark.createDataFrame(asked, "node string, fact int")
    every = {tuple(r) for r in ifds.path_edges(*frames, seeds).select("entry", "entry_fact", "node", "fact").collect()}
    found = {tuple(r) for r in ifds.demanded(*frames, seeds, queries).select("entry", "entry_fact", "node", "fact").collect()}
    useful = {tuple(r) for r in ifds.relevant(*frames, queries).collect()}
    assert found == {r for r in every if (r[2], r[3]) in set(asked)} and found
    assert sum((r[2], r[3]) not in useful for r in every) > len(every) / 4  # rows that the demand leaves out


def test_reach_after_changes_is_that_of_a_full_run(spark):
    random.seed(4)
    edges, removed, added, origins = set(), set(), set(), []
    for k in range(30):
        edge = lambda: (random.randrange(14) + 100 * k, random.randrange(14) + 100 * k)  # noqa: B023, E731
        some = {edge() for _ in range(18)}
        gone = set(random.sample(sorted(some), 4)) | {edge()}
        edges, removed = edges | some, removed | gone
        added |= {edge() for _ in range(3)} | set(list(gone)[:1])
        origins += [(o + 100 * k, o + 100 * k) for o in (0, 3, 5)]
    full = lambda es: {(o, n) for o, s in origins for n in closure_of([s], lambda x: [b for a, b in es if a == x])}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src int, dst int")
    pairs = lambda rows: spark.createDataFrame(sorted(rows), "origin int, node int")
    got = incremental.reach_after(pairs(full(edges)), frame(edges), frame(added), frame(removed), pairs(origins))
    assert sorted(tuple(r) for r in got.collect()) == sorted(full((edges - removed) | added))


def test_reach_after_touches_the_affected_part_only(spark, monkeypatch):
    """Ten chains, an edge of one is removed: no round writes rows of another."""
    edges = [(100 * c + k, 100 * c + k + 1) for c in range(10) for k in range(12)]
    origins = [(100 * c, 100 * c) for c in range(10)]
    reached = [(100 * c, 100 * c + k) for c in range(10) for k in range(13)]
    written = []
    from millrace.operators import fixpoint

    original = fixpoint.stored
    monkeypatch.setattr(fixpoint, "stored", lambda df: written.append(original(df)) or written[-1])
    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int")
    pairs = lambda rows: spark.createDataFrame(rows, "origin int, node int")
    monkeypatch.setattr(fixpoint, "discard", lambda df: None)
    got = incremental.reach_after(pairs(reached), frame(edges), frame([(306, 308)]), frame([(306, 307)]), pairs(origins))
    assert got.count() == len(reached) - 1
    assert {r.origin for t in written for r in t.collect()} == {300}


def test_thin_slices_and_labels_on_random_functions(spark):
    random.seed(8)
    chains, computes, control, sources, carrying = [], [], [], [], []
    for f in range(25):
        for _ in range(9):
            chains.append((f, random.choice("xyz"), random.randrange(7), random.randrange(7)))
        computes += [(f, random.randrange(7), random.choice("xyz"), random.choice("xyz")) for _ in range(9)]
        control += [(f, random.randrange(7), random.randrange(7)) for _ in range(3)]
        sources += [(f, random.randrange(7), random.choice(["file", "net"])) for _ in range(2)]
        carrying += [(f, b) for b in range(7) if random.random() < 0.6]
    df = lambda rows, schema: stored(spark.createDataFrame(rows, schema))
    c = df(chains, "func int, variable string, def_block int, use_block int")
    got = {tuple(r) for r in dependence.thin_slices(c, df(computes, "func int, block int, used string, defined string"), df([(f, 6, "x") for f in range(25)], "func int, block int, variable string")).select("func", "block", "variable").collect()}

    def producers(f, at, read):
        return [(f, d, v) for g, v, d, u in chains if (g, v, u) == (f, read, at)]

    want = set()
    for f in range(25):
        want |= closure_of(producers(f, 6, "x"), lambda p: [q for g, b, used, defined in computes if (g, b, defined) == p for q in producers(p[0], p[1], used)])
    assert got == want

    got = {tuple(r) for r in dependence.labelled(c.select("func", F_col("def_block", "src"), F_col("use_block", "dst")), df(control, "func int, src int, dst int"), df(sources, "func int, block int, label string"), df(carrying, "func int, block int")).select("func", "block", "what", "label", "implicit").collect()}

    def step(s):
        f, b, what, label, implicit = s
        if what == "set":
            return [(f, u, "read", label, implicit) for g, _, d, u in chains if (g, d) == (f, b)]
        on = [(f, d, "runs", label, True) for g, a, d in control if (g, a) == (f, b)]
        return on + ([(f, b, "set", label, True)] if what == "runs" else [(f, b, "set", label, implicit)] if (f, b) in carrying else [])

    assert got == closure_of([(f, b, "set", label, False) for f, b, label in sources], step)


def F_col(name, alias):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias)


def test_no_rows(spark):
    flow, calls, returns = (spark.createDataFrame([], s) for s in ("node string, fact int, to_node string, to_fact int", "site string, fact int, entry string, entry_fact int", "exit string, fact int, site string, to_node string, to_fact int"))
    places = spark.createDataFrame([], "node string, fact int")
    assert ifds.demanded(flow, calls, returns, places, places).isEmpty()
    inside, across = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "site int, src string, dst string")
    assert sdg.summaries(inside, across, across).isEmpty()
    assert sdg.two_phase_slice(inside, across, across, spark.createDataFrame([("a", "a")], "origin string, node string")).count() == 1


def test_one_pass_equals_rounds(spark):
    """Facts and slices of what one task holds, by plain values, against the relational forms; recursion included."""
    r = random.Random(4)
    systems = [random_system(seed) for seed in range(12)]
    inside, into, back = (sum((s[k] for s in systems), []) for k in (1, 2, 3))
    frames = [stored(spark.createDataFrame(rows, schema)) for rows, schema in ((inside, "src string, dst string"), (into, "site int, src string, dst string"), (back, "site int, src string, dst string"))]
    criteria = [n for s in systems for n in s[0]]
    want = {(x.origin, x.node) for x in sdg.two_phase_slice(*frames, spark.createDataFrame([(n, n) for n in criteria], "origin string, node string")).collect()}
    assert {(c, n) for c, found in sdg.sliced(inside, into, back, criteria).items() for n in found} == want

    place = lambda s: (f"{s}{r.choice('abcdefgh')}", r.randrange(3))
    flow = [(*place(s), *place(s)) for s in range(12) for _ in range(14)]
    calls = [row for s in range(12) for row in [(f"{s}c", f, f"{s}e", f) for f in range(3)] + [(f"{s}a", 1, f"{s}g", 2)]]
    returns = [row for s in range(12) for row in [(f"{s}f", f, f"{s}c", f"{s}d", f) for f in range(3)] + [(f"{s}h", 1, f"{s}a", f"{s}b", 0)]]
    seeds = [x for s in range(12) for x in ((f"{s}a", 0), (f"{s}a", 1), (f"{s}b", 2))]
    frames = [stored(spark.createDataFrame(rows, schema)) for rows, schema in ((flow, "node string, fact int, to_node string, to_fact int"), (calls, "site string, fact int, entry string, entry_fact int"), (returns, "exit string, fact int, site string, to_node string, to_fact int"))]
    want = {tuple(x) for x in ifds.path_edges(*frames, spark.createDataFrame(seeds, "node string, fact int")).select("entry", "entry_fact", "node", "fact").collect()}
    ways = lambda rows, *key: [x[len(key):] for x in rows if x[: len(key)] == key]
    back = [(end, fact, site, to, to_fact) for end, fact, site, to, to_fact in returns]
    # Here a place may return from any procedure that reaches it, as in the relations: by site and entry.
    found = ifds.tabulated(lambda n, f: ways(flow, n, f), lambda n, f: ways(calls, n, f), lambda n, f, site: ways(back, n, f, site), seeds)
    assert found == want


def test_call_groups_need_no_rounds(spark, tmp_path):
    """No table is written by rounds, whatever the way through the calls."""
    from millrace.plans import interprocedural_queries as q

    rows = [(1, 10 * k + 1, 1 + k % 7, 4 * k + 1, 4 * k, 3.0 * k, "ARN"[k % 3]) for k in range(4)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, x long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("facts_along_valid_ways", "demanded_facts", "interprocedural_slices"):
        plan = q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "table-" not in plan and plan.count("Relation") == 2
