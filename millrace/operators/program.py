"""Queries over the flow relations of functions: slices, chops, complexity, integrity, constants.

``dfg`` is (func, variable, from_line, to_line), ``cdg`` (func, from_line,
to_line), ``blocks`` (func, block, block_type, start_line, end_line) and
``edges`` (func, src, dst). Lines and blocks of one function meet only their
own, by nodes of the form struct<func, at>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored
from millrace.operators import graph
from millrace.operators.fixpoint import closure


def _at(column: str):
    return F.struct("func", F.col(column).alias("at"))


def line_edges(dfg: DataFrame, variable: str | None = None, cdg: DataFrame | None = None) -> DataFrame:
    """Dependences between lines; of one variable only, or together with control dependences."""
    some = dfg if variable is None else dfg.where(F.col("variable") == variable)
    data = some.select(_at("from_line").alias("src"), _at("to_line").alias("dst"))
    return data if cdg is None else data.unionByName(cdg.select(_at("from_line").alias("src"), _at("to_line").alias("dst")))


def slices(dfg: DataFrame, criteria: DataFrame, backward: bool = True, variable: str | None = None, cdg: DataFrame | None = None) -> DataFrame:
    """(func, line, distance): what ``criteria`` (func, line) depend on, or what depends on them; lines without edges give nothing."""
    edges = line_edges(dfg, variable, cdg)
    seeds = criteria.select(_at("line").alias("node")).join(graph.nodes_of(edges), "node", "left_semi")
    return graph.reach(edges, seeds, backward=backward).select("node.func", F.col("node.at").alias("line"), "distance")


def chops(dfg: DataFrame, sources: DataFrame, targets: DataFrame, variable: str | None = None) -> DataFrame:
    """(func, line) on a way from ``sources`` to ``targets`` (func, line)."""
    found = graph.chop(line_edges(dfg, variable), sources.select(_at("line").alias("node")), targets.select(_at("line").alias("node")))
    return found.select("node.func", F.col("node.at").alias("line"))


def cyclomatic(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(func, complexity): edges less blocks and two, one at least."""
    e, n = edges.groupBy("func").agg(F.count("*").alias("e")), blocks.groupBy("func").agg(F.count("*").alias("n"))
    return n.join(e, "func", "left").select("func", F.greatest(F.lit(1), F.coalesce("e", F.lit(0)) - F.col("n") + 2).alias("complexity"))


def invalid_edges(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with an end that is no block of their function."""
    known = blocks.select("func", F.col("block"))
    bad = [edges.join(known.withColumnRenamed("block", end), ["func", end], "left_anti").select("func", "src", "dst") for end in ("src", "dst")]
    return bad[0].unionByName(bad[1]).distinct()


def unreachable_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(func, block) that no entry block reaches."""
    steps = edges.select(_at("src").alias("src"), _at("dst").alias("dst"))
    entries = blocks.where("block_type = 'entry'").select(_at("block").alias("node"))
    return blocks.select(_at("block").alias("node")).join(graph.reach(steps, entries).select("node"), "node", "left_anti").select("node.func", F.col("node.at").alias("block"))


def block_for_line(blocks: DataFrame, lines: DataFrame, span: int = 64) -> DataFrame:
    """``lines`` (func, line) with the block whose range holds the line: an equi-join on function and cells of ``span`` lines, then the range."""
    cells = blocks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))))
    met = lines.withColumn("cell", F.floor(F.col("line") / span)).join(cells, ["func", "cell"])
    return met.where("line between start_line and end_line").groupBy("func", "line").agg(F.min("block").alias("block"))


def constants(edges: DataFrame, sets: DataFrame, entry_unknown: DataFrame) -> DataFrame:
    """(func, block, variable, value) known at a block's entry: every definition that reaches it sets the one same constant.

    ``sets`` is (func, block, variable, value), null where the value is not
    constant; ``entry_unknown`` (func, block, variable) gives variables that
    hold anything at an entry block. Reaching definitions, then a meet by
    aggregation; a conflict or a null is no constant.
    """
    sets = stored(sets.unionByName(entry_unknown.withColumn("value", F.lit(None).cast(sets.schema["value"].dataType))))
    steps = kept(edges.select("func", F.col("src").alias("block"), "dst").distinct())
    onward = lambda rows: rows.join(steps, ["func", "block"]).select("func", F.col("dst").alias("block"), "variable", "by")
    at_exit = sets.select("func", "block", "variable", F.col("block").alias("by"))
    reaching = closure(onward(at_exit), lambda new: onward(new.join(sets.select("func", "block", "variable"), ["func", "block", "variable"], "left_anti")))
    valued = reaching.join(sets.select("func", F.col("block").alias("by"), "variable", "value"), ["func", "by", "variable"])
    met = valued.groupBy("func", "block", "variable").agg(F.min("value").alias("value"), F.max("value").alias("high"), F.bool_or(F.col("value").isNull()).alias("any"))
    return met.where("not any and value = high").select("func", "block", "variable", "value")
