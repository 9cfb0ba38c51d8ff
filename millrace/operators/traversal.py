"""Traversals of a labelled graph, composed before anything runs.

A graph has ``nodes`` (node, kind, name, var, proc) and ``edges`` (src, dst,
family, label). A traversal maps a set of nodes, DataFrame (node), to another;
``then``, ``|``, ``&``, ``-``, ``^`` and ``~`` combine traversals. Until an
action all of it is one plan; only closures run rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph as reachability


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def well_formed(self) -> DataFrame:
        """(problem, n): repeated nodes, edges whose end is no node; no rows if all is well."""
        twice = self.nodes.groupBy("node").count().where("count > 1").select(F.lit("repeated_node").alias("problem"))
        known = self.nodes.select("node").distinct()
        loose = [self.edges.join(known, self.edges[end] == known["node"], "left_anti").select(F.lit(f"unknown_{end}").alias("problem")) for end in ("src", "dst")]
        return twice.unionByName(loose[0]).unionByName(loose[1]).groupBy("problem").agg(F.count("*").alias("n"))


def exact(label: str) -> Column:
    return F.col("label") == label


def prefix(label: str) -> Column:
    return F.col("label").startswith(label)


def family(*names: str) -> Column:
    return F.col("family").isin(*names)



class Traversal:
    """A function of (graph, nodes) with set operations."""

    def __init__(self, run: Callable[[Graph, DataFrame], DataFrame]):
        self.run = run

    def __call__(self, graph: Graph, start: DataFrame) -> DataFrame:
        return self.run(graph, start.select("node").distinct()).select("node").distinct()

    def then(self, *others: Traversal) -> Traversal:
        out = self
        for other in others:
            out = Traversal(lambda g, s, a=out, b=other: b(g, a(g, s)))
        return out

    def __or__(self, other: Traversal) -> Traversal:
        return Traversal(lambda g, s: self(g, s).unionByName(other(g, s)))

    def __and__(self, other: Traversal) -> Traversal:
        return Traversal(lambda g, s: self(g, s).join(other(g, s), "node", "left_semi"))

    def __sub__(self, other: Traversal) -> Traversal:
        return Traversal(lambda g, s: self(g, s).join(other(g, s), "node", "left_anti"))

    def __xor__(self, other: Traversal) -> Traversal:
        return (self - other) | (other - self)

    def __invert__(self) -> Traversal:
        return Traversal(lambda g, s: g.nodes.select("node").join(self(g, s), "node", "left_anti"))


IDENTITY = Traversal(lambda g, s: s)
EMPTY = Traversal(lambda g, s: s.limit(0))
EVERYTHING = Traversal(lambda g, s: g.nodes)


def where(condition: Column | str) -> Traversal:
    """Keep nodes whose row fulfils a condition on kind, name, var or proc."""
    return Traversal(lambda g, s: g.nodes.where(condition).join(s, "node", "left_semi"))


def out(labels: Column | None = None) -> Traversal:
    """One step along edges."""
    return Traversal(lambda g, s: _chosen(g, labels).join(s, F.col("src") == F.col("node")).select(F.col("dst").alias("node")))


def into(labels: Column | None = None) -> Traversal:
    """One step against edges."""
    return Traversal(lambda g, s: _chosen(g, labels).join(s, F.col("dst") == F.col("node")).select(F.col("src").alias("node")))


def closure(labels: Column | None = None, backward: bool = False, depth: int | None = None) -> Traversal:
    """All nodes that steps lead to, the first ones included."""
    return Traversal(lambda g, s: reachability.reach(_chosen(g, labels).select("src", "dst"), s, depth, backward))


def _chosen(graph: Graph, labels: Column | None) -> DataFrame:
    return graph.edges if labels is None else graph.edges.where(labels)


def definitions_of(variable: str) -> Traversal:
    return where((F.col("kind") == "def") & (F.col("var") == variable))


def uses_of(variable: str) -> Traversal:
    return where((F.col("kind") == "use") & (F.col("var") == variable))


def dependence_slice(backward: bool = True) -> Traversal:
    """What nodes depend on, or what depends on them, by data and control."""
    return closure(family("ddg", "cdg"), backward)


def two_phase_backward_slice(graph: Graph, criteria: DataFrame) -> DataFrame:
    """Up through callers without going into procedures, then down into them without coming back up."""
    up = closure(family("ddg", "cdg", "call"), backward=True)
    down = closure(family("ddg", "cdg", "return"), backward=True)
    return up.then(down)(graph, criteria)
