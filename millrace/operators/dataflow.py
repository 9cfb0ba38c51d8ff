"""Gen/kill dataflow over many control-flow graphs at once, as fixpoints on (func, block, fact) relations.

``edges`` is (func, src, dst), ``gen`` and ``kill`` are (func, block, fact).
May-analyses grow the set of facts that hold; must-analyses grow the set of
those that do not, starting where a block has no predecessor, so both are
semi-naive. Run backward analyses on reversed edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored
from millrace.operators.fixpoint import closure

_KEY = ["func", "block", "fact"]


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select("func", F.col("dst").alias("src"), F.col("src").alias("dst"))


def _spread(start: DataFrame, edges: DataFrame, stop: DataFrame) -> DataFrame:
    """Facts at the entry of blocks: ``start`` (at exits) carried along edges, through blocks where ``stop`` has no such fact."""
    steps, stop = kept(edges.select("func", F.col("src").alias("block"), "dst").distinct()), kept(stop)
    onward = lambda rows: rows.join(steps, ["func", "block"]).select("func", F.col("dst").alias("block"), "fact")
    return closure(onward(start.select(*_KEY).distinct()), lambda new: onward(new.join(stop, _KEY, "left_anti")))


def may_forward(edges: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    """(func, block, fact) that may hold at the block's entry: reaching definitions, or on flipped edges live variables."""
    return _spread(gen, edges, kill.select(*_KEY).distinct())


def must_forward(edges: DataFrame, gen: DataFrame, kill: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func, block, fact) that hold at the block's entry on every way there: available, or on flipped edges very busy expressions.

    ``blocks`` is (func, block). Blocks without predecessors hold nothing.
    """
    universe = stored(blocks.join(gen.select("func", "fact").distinct(), "func").select(*_KEY))
    starts = universe.join(edges.select("func", F.col("dst").alias("block")).distinct(), ["func", "block"], "left_anti")
    killed = kill.select(*_KEY).distinct().join(gen.select(*_KEY), _KEY, "left_anti")
    passing = gen.select(*_KEY).distinct()
    missing_out = killed.join(universe, _KEY, "left_semi").unionByName(starts.join(passing, _KEY, "left_anti"))
    missing = _spread(missing_out, edges, passing).unionByName(starts)
    return universe.join(missing, _KEY, "left_anti")


def def_use_chains(reaching: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses`` (func, block, variable) with each reaching definition; ``fact`` is struct<variable, block>."""
    defs = reaching.select("func", "block", F.col("fact.variable").alias("variable"), F.col("fact.block").alias("def_block"))
    return uses.join(defs, ["func", "block", "variable"]).select("func", "variable", "def_block", F.col("block").alias("use_block"))
