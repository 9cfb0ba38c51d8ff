"""Connected components of an edge table, by contraction.

Every round each node looks to the neighbour whose hash is least in that round,
or to itself if its own is, and goes over to what that one looks to; the edges
are then drawn between what the nodes went over to, without loops and repeats. About half of the nodes at least go
in every round, whatever the shape of the graph, so the tables shrink
geometrically and a long chain takes a logarithmic number of rounds. Going
over is a partial minimum per node and the redrawing two equi-joins: a hub of
any degree is pre-aggregated in the mappers and its join can be split by AQE;
nothing is gathered per node. The rounds are composed backwards at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import discard, stored

#: Rows of a task in a round, and tasks at least.
ROWS, FEWEST = 1_000_000, 8


def _tasks(rows: int) -> int:
    """Tasks for a table of that many rows; the last rounds are small whatever the session's partitions are."""
    return FEWEST + rows // ROWS


def _step(edges: DataFrame, number: int, tasks: int) -> DataFrame:
    """(node, to) for every node of ``edges`` (u, v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rank = F.xxhash64("v", F.lit(number))
    least = both.groupBy("u").agg(F.min(rank).alias("least"), F.min_by("v", rank).alias("v")).coalesce(tasks)
    looks = least.select(F.col("u").alias("node"), F.when(F.col("least") < F.xxhash64("u", F.lit(number)), F.col("v")).otherwise(F.col("u")).alias("via"))
    further = looks.select(F.col("node").alias("via"), F.col("via").alias("to"))
    return looks.join(further, "via").select("node", "to").coalesce(tasks)


def _redrawn(edges: DataFrame, step: DataFrame, tasks: int) -> DataFrame:
    for end in ("u", "v"):
        edges = edges.join(step.withColumnRenamed("node", end), end).coalesce(tasks).drop(end).withColumnRenamed("to", end)
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root: the component's smallest node.

    Rows with a null end and self-loops are ignored, repeated edges count once.
    An empty table of edges gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u > v")
    current, steps = stored(pairs.distinct()), []
    while rows := current.count():  # from the files' footers
        steps.append(stored(_step(current, len(steps), _tasks(rows))))
        following = stored(_redrawn(current, steps[-1], _tasks(rows)))
        discard(current)
        current = following
    if not steps:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps.pop()
    while steps:
        step = steps.pop()
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = step.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    found = stored(found)
    roots = found.groupBy("to").agg(F.min("node").alias("root"))
    return found.join(roots, "to").select("node", "root")
