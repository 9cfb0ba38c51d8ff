"""Interprocedural facts along valid ways: path edges and summary edges, tabulated by joins.

Relations over the exploded graph, a place being (node, fact): ``flow`` (node,
fact, to_node, to_fact) inside procedures and past calls, ``calls`` (site,
fact, entry, entry_fact), ``returns`` (exit, fact, site, to_node, to_fact). A
way is valid if every return goes back to the call that it came from.

``tabulated`` is the same for procedures that call one another only and that
one task can hold, at once and without rounds over all procedures.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import stored
from millrace.operators.fixpoint import Found, closure

_PATH = ["entry", "entry_fact", "node", "fact"]
_SUMMARY = ["site", "site_fact", "to_node", "to_fact"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def path_edges(flow: DataFrame, calls: DataFrame, returns: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entry, entry_fact, node, fact): what holds at places of a procedure if (entry, entry_fact) holds where it begins; from ``seeds`` (node, fact).

    Semi-naive: each round joins the newest path edges with flow, calls and the
    summaries, and all path edges with the newest summaries.
    """
    at = lambda df, node, fact: df.select(F.col(node).alias("entry"), F.col(fact).alias("entry_fact"), F.col(node).alias("node"), F.col(fact).alias("fact"))
    past = lambda path, over: path.join(over.withColumnsRenamed({"site": "node", "site_fact": "fact"}), ["node", "fact"]).select("entry", "entry_fact", F.col("to_node").alias("node"), F.col("to_fact").alias("fact"))
    callers = calls.withColumnRenamed("fact", "site_fact")
    paths, short = Found(_PATH), Found(_SUMMARY)
    newest = paths.add(at(seeds, "node", "fact"))
    while not newest.isEmpty():
        paths.keep()
        ended = newest.join(returns.withColumnRenamed("exit", "node"), ["node", "fact"]).join(callers, ["site", "entry", "entry_fact"])
        summary = short.add(ended)
        step = newest.join(flow, ["node", "fact"]).select("entry", "entry_fact", F.col("to_node").alias("node"), F.col("to_fact").alias("fact"))
        entered = newest.select(F.col("node").alias("site"), F.col("fact").alias("site_fact")).join(callers, ["site", "site_fact"])
        found = [step, at(entered, "entry", "entry_fact")]
        if short.tables:
            found.append(past(newest, short.all()))
        grown = not summary.isEmpty()
        if grown:
            found.append(past(paths.all(), summary))
        newest = paths.add(_union(found))
        if grown:
            short.keep()
    return paths.all() if paths.tables else newest


def holding(paths: DataFrame) -> DataFrame:
    """(node, fact) that hold."""
    return paths.select("node", "fact").distinct()


def relevant(flow: DataFrame, calls: DataFrame, returns: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, fact) from which ``queries`` (node, fact) can be reached, calls and returns not matched: more places than matter, and none too few."""
    place = lambda df, node, fact, to, to_fact: df.select(F.col(to).alias("node"), F.col(to_fact).alias("fact"), F.col(node).alias("from_node"), F.col(fact).alias("from_fact"))
    back = stored(_union([place(flow, "node", "fact", "to_node", "to_fact"), place(calls, "site", "fact", "entry", "entry_fact"), place(returns, "exit", "fact", "to_node", "to_fact")]).distinct())
    return closure(queries.select("node", "fact"), lambda new: new.join(back, ["node", "fact"]).select(F.col("from_node").alias("node"), F.col("from_fact").alias("fact")))


def demanded(flow: DataFrame, calls: DataFrame, returns: DataFrame, seeds: DataFrame, queries: DataFrame) -> DataFrame:
    """Path edges at the places that ``queries`` (node, fact) ask for: the same rows as ``path_edges`` has there.

    What cannot lead to a query is left out before the tabulation begins, from
    each relation and the seeds, so that it reads and grows only what may
    matter.
    """
    useful = stored(relevant(flow, calls, returns, queries))
    leading = lambda df, node, fact: df.join(useful.select(F.col("node").alias(node), F.col("fact").alias(fact)), [node, fact], "left_semi")
    some = [stored(leading(flow, "to_node", "to_fact")), stored(leading(calls, "entry", "entry_fact")), stored(leading(returns, "to_node", "to_fact"))]
    paths = path_edges(*some, leading(seeds, "node", "fact"))
    return paths.join(queries.select("node", "fact").distinct(), ["node", "fact"], "left_semi")


def tabulated(flow: Callable[[Hashable, Hashable], Iterable[tuple]], calls: Callable[[Hashable, Hashable], Iterable[tuple]], returns: Callable[[Hashable, Hashable, Hashable], Iterable[tuple]], seeds: Iterable[tuple]) -> set[tuple]:
    """(entry, entry_fact, node, fact) as ``path_edges``; the relations are functions of plain values.

    ``flow`` (node, fact) gives (to_node, to_fact), ``calls`` (site, fact)
    gives (entry, entry_fact), ``returns`` (exit, fact, site) gives (to_node,
    to_fact): nothing where the node is no exit of what the site calls.
    """
    found = {(*s, *s) for s in seeds}
    todo, callers, reached = list(found), defaultdict(set), defaultdict(set)

    def add(*path) -> None:
        if path not in found:
            found.add(path)
            todo.append(path)

    while todo:
        entry, entry_fact, node, fact = todo.pop()
        for to in flow(node, fact):
            add(entry, entry_fact, *to)
        for begun in calls(node, fact):
            add(*begun, *begun)
            callers[begun].add((entry, entry_fact, node))
            for end in list(reached[begun]):
                for to in returns(*end, node):
                    add(entry, entry_fact, *to)
        reached[entry, entry_fact].add((node, fact))
        for outer, outer_fact, site in list(callers[entry, entry_fact]):
            for to in returns(node, fact, site):
                add(outer, outer_fact, *to)
    return found
