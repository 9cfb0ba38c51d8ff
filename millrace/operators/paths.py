"""Ways through many graphs at once: how many there are, and which, up to a length.

``edges`` is (func, src, dst), ``sources`` and ``targets`` are (func, block).
Counts are cheap, one row a place and length, whatever the number of ways; ask
them before ways are listed, since these may be very many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored

_PLACE = ["func", "block"]


def _steps(edges: DataFrame) -> DataFrame:
    return kept(edges.select("func", F.col("src").alias("block"), "dst").distinct())


def walk_counts(edges: DataFrame, sources: DataFrame, longest: int) -> DataFrame:
    """(func, block, length, walks): ways from ``sources`` to a block in so many steps, those that go round loops among them: no fewer than there are loop-free ones."""
    steps = _steps(edges)
    levels = [stored(sources.select(*_PLACE).distinct().withColumns({"length": F.lit(0), "walks": F.lit(1).cast("decimal(38,0)")}))]
    for length in range(1, longest + 1):
        ahead = levels[-1].join(steps, _PLACE).groupBy("func", F.col("dst").alias("block")).agg(F.sum("walks").cast("decimal(38,0)").alias("walks"))
        levels.append(stored(ahead.select(*_PLACE, F.lit(length).alias("length"), "walks")))
    return reduce(DataFrame.unionByName, levels)


def _nearness(steps: DataFrame, targets: DataFrame, longest: int) -> DataFrame:
    """(func, block, left): the fewest steps from a block to a target, where ``longest`` suffice."""
    back = steps.select("func", F.col("block").alias("to"), F.col("dst").alias("block"))
    levels = [stored(targets.select(*_PLACE).distinct().withColumn("left", F.lit(0)))]
    for left in range(1, longest + 1):
        before = levels[-1].join(back, _PLACE).select("func", F.col("to").alias("block")).distinct()
        for level in levels:
            before = before.join(level, _PLACE, "left_anti")
        levels.append(stored(before.withColumn("left", F.lit(left))))
    return stored(reduce(DataFrame.unionByName, levels))


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, longest: int) -> DataFrame:
    """(func, path): every way from ``sources`` to ``targets`` of at most ``longest`` steps that meets no block twice; ``path`` is the array of its blocks.

    A way that cannot come to a target in the steps that are left is given up
    at once, so nothing grows that ends nowhere but for its own loops. A way
    may pass a target and end at another.
    """
    steps = _steps(edges)
    near = _nearness(steps, targets, longest)
    ends = targets.select(*_PLACE).distinct()
    ways = [stored(sources.select(*_PLACE).distinct().join(near, _PLACE).select(*_PLACE, F.array("block").alias("path")))]
    for length in range(1, longest + 1):
        ahead = ways[-1].join(steps, _PLACE).where("not array_contains(path, dst)").select("func", F.col("dst").alias("block"), F.concat("path", F.array("dst")).alias("path"))
        ways.append(stored(ahead.join(near.where(F.col("left") <= longest - length), _PLACE, "left_semi")))
    return reduce(DataFrame.unionByName, ways).join(ends, _PLACE, "left_semi").select("func", "path")
