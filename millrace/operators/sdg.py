"""Slices over a system dependence graph: calls are matched with their returns.

Nodes are of any type. ``inside`` (src, dst) are dependences within functions,
``param_in`` (site, src, dst) lead from what a call passes to what the callee
takes, ``param_out`` (site, src, dst) from what it gives back to what the call
receives. A way is realisable if each return goes back to the call by which
it came; a summary edge stands for such a way through a callee and back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored
from millrace.operators.fixpoint import Found, closure


def summaries(inside: DataFrame, param_in: DataFrame, param_out: DataFrame) -> DataFrame:
    """(src, dst): what a call passes and what it receives that depends on it, by ways through the callee at any depth, recursion included.

    Grows two relations at once: (taken, node), what a function's parameter
    reaches inside of it, and the summaries, which are further steps inside
    the callers. Each round joins the newest of one with all of the other.
    """
    steps = kept(inside.select(F.col("src").alias("node"), "dst").distinct())
    calls = kept(param_in.join(param_out.select("site", F.col("src").alias("given"), F.col("dst").alias("received")), "site").select(F.col("src").alias("passed"), F.col("dst").alias("taken"), "given", "received").distinct())
    reaching, short = Found(["taken", "node"]), Found(["passed", "received"])
    newest = reaching.add(param_in.select(F.col("dst").alias("taken"), F.col("dst").alias("node")))
    while not newest.isEmpty():
        reaching.keep()
        through = short.add(newest.withColumnRenamed("node", "given").join(calls, ["taken", "given"]))
        ahead = newest.join(steps, "node").select("taken", F.col("dst").alias("node"))
        over = lambda rows, by: rows.join(by.withColumnRenamed("passed", "node"), "node").select("taken", F.col("received").alias("node"))
        if short.tables:  # what the newest rows reach by summaries of earlier rounds
            ahead = ahead.unionByName(over(newest, short.all()))
        grown = not through.isEmpty()
        if grown:
            ahead = ahead.unionByName(over(reaching.all(), through))
        newest = reaching.add(ahead)
        if grown:
            short.keep()
    return short.all().select(F.col("passed").alias("src"), F.col("received").alias("dst")) if short.tables else calls.select(F.col("passed").alias("src"), F.col("received").alias("dst"))


def two_phase_slice(inside: DataFrame, param_in: DataFrame, param_out: DataFrame, criteria: DataFrame, backward: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """(origin, node): what each of ``criteria`` (origin, node) depends on along realisable ways, or what depends on it.

    The first phase stays in the criterion's function and its callers, the
    second goes down into callees from all that the first found and never up
    again; summaries carry both past calls.
    """
    ends = lambda df: df.select("src", "dst")
    flat = stored(ends(inside).unionByName(ends(summaries(inside, param_in, param_out) if summary is None else summary)).distinct())
    up, down = (param_in, param_out) if backward else (param_out, param_in)
    here, there = ("dst", "src") if backward else ("src", "dst")

    def phase(start: DataFrame, across: DataFrame) -> DataFrame:
        steps = stored(flat.unionByName(ends(across)).select(F.col(here).alias("node"), F.col(there).alias("to")).distinct())
        return closure(start, lambda new: new.join(steps, "node").select("origin", F.col("to").alias("node")))

    return phase(phase(criteria.select("origin", "node"), up), down)


def _closed(start: Iterable, *steps: dict) -> set:
    seen, todo = set(start), list(start)
    while todo:
        node = todo.pop()
        for step in steps:
            for to in step.get(node, ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return seen


def sliced(inside: Iterable[tuple], param_in: Iterable[tuple], param_out: Iterable[tuple], criteria: Iterable) -> dict:
    """{criterion: nodes} backward as ``two_phase_slice``, of relations that one task can hold, as plain tuples."""
    flat, up, down = defaultdict(set), defaultdict(set), defaultdict(set)
    for src, dst in inside:
        flat[dst].add(src)
    passed, received = defaultdict(list), defaultdict(list)
    for site, src, dst in param_in:
        up[dst].add(src)
        passed[site].append((src, dst))
    for site, src, dst in param_out:
        down[dst].add(src)
        received[site].append((src, dst))
    grown = True
    while grown:  # a summary is a further step inside, until there is none
        grown, before = False, {}
        for site, gives in received.items():
            for given, got in gives:
                if given not in before:
                    before[given] = _closed([given], flat)
                new = {source for source, taken in passed.get(site, ()) if taken in before[given]} - flat[got]
                if new:
                    flat[got] |= new
                    grown = True
    return {c: _closed(_closed([c], flat, up), flat, down) for c in criteria}
