"""Reachability, layers and strong components over edge tables (src, dst).

Loops are semi-naive: a round joins only the newest nodes with the edges and
leaves out, by an anti join, what earlier rounds found. What a round finds is
written, so lineage stays short and survives lost executors, and the tables of
rounds are merged (``fixpoint.py``); the driver sees only whether a round was
empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import discard, kept, stored
from millrace.operators.fixpoint import Found, closure


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, backward: bool = False) -> DataFrame:
    """(node, distance): what ``seeds`` (node) reach, themselves at 0, by the shortest way; at most ``max_depth`` steps."""
    edges = kept(edges)  # read in every round
    steps = reversed_edges(edges) if backward else edges
    found, rounds = Found(["node", "distance"], ["node"]), 0
    newest = found.add(seeds.select("node").withColumn("distance", F.lit(0)))
    while True:
        found.keep()
        if rounds == max_depth:
            return found.all()
        rounds += 1
        ahead = newest.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
        newest = found.add(ahead.withColumn("distance", F.lit(rounds)))
        if newest.isEmpty():
            return found.all()


def reach_pairs(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, node): what each of ``origins`` (node) reaches in one step or more."""
    edges = kept(edges)
    ahead = lambda rows: rows.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
    return closure(ahead(origins.select(F.col("node").alias("origin"), "node").distinct()), ahead)


def reach_from(edges: DataFrame, origins: DataFrame, max_depth: int) -> DataFrame:
    """(origin, node, distance): what each of ``origins`` (node) reaches in at most so many steps, itself included, by the shortest way."""
    edges = kept(edges)
    found = Found(["origin", "node", "distance"], ["origin", "node"])
    newest = found.add(origins.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance")))
    for distance in range(1, max_depth + 1):
        found.keep()
        newest = found.add(newest.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), F.lit(distance).alias("distance")))
    found.keep()
    return found.all()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def roles(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, role) by distinct neighbours: entry, leaf, middle."""
    ends = edges.distinct()
    both = ends.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(ends.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degrees = both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return degrees.withColumn("role", F.when(F.col("fan_in") == 0, "entry").when(F.col("fan_out") == 0, "leaf").otherwise("middle"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): longest distance from a node without predecessors; nodes on or behind a cycle are in no layer."""
    left = stored(edges.distinct())
    nodes = stored(nodes_of(left))
    found: list[DataFrame] = []
    while True:
        layer = stored(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(len(found))))
        if layer.isEmpty():
            return _all([*found, layer])
        found.append(layer)
        rest, later = stored(left.join(layer.select(F.col("node").alias("src")), "src", "left_anti")), stored(nodes.join(layer, "node", "left_anti"))
        discard(left)
        discard(nodes)
        left, nodes = rest, later


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): by colours. A colour is the greatest node that reaches a node; within a colour, what reaches that greatest node is its component."""
    links = stored(edges.where("src != dst").distinct())
    open_nodes = stored(nodes_of(edges))  # a node of a self-loop alone counts
    done: list[DataFrame] = []
    while not open_nodes.isEmpty():
        colours = stored(open_nodes.withColumn("colour", F.col("node")))
        while True:
            sent = links.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("better"))
            raised = stored(colours.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("better", "colour")).alias("colour"), (F.coalesce("better", "colour") > F.col("colour")).alias("changed")))
            settled = raised.where("changed").isEmpty()
            discard(colours)
            colours = raised.drop("changed")
            colours._stored_at = raised._stored_at
            if settled:
                break
        ends = links.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = stored(ends.where("a = b").select("src", "dst"))
        members = reach(inside, colours.where("node = colour").select("node"), backward=True)
        component = stored(members.join(colours, "node").select("node", F.col("colour").alias("component")))
        done.append(component)
        open_nodes = stored(open_nodes.join(component, "node", "left_anti"))
        left = links.join(open_nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
        links = stored(left.select("src", "dst"))
    return _all(done) if done else open_nodes.withColumn("component", F.col("node"))


def chop(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(node): on a way from ``sources`` to ``targets``, both ends included."""
    edges = kept(edges)
    return reach(edges, sources).select("node").intersect(reach(edges, targets, backward=True).select("node"))


def unsanitized(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """``sinks`` that ``sources`` reach on a way that meets no sanitizer."""
    clean = edges.join(sanitizers.select(F.col("node").alias("src")), "src", "left_anti").join(sanitizers.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return sinks.join(reach(clean, sources.join(sanitizers, "node", "left_anti")).select("node"), "node", "left_semi")
