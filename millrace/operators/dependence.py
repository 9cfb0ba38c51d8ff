"""Slices and taint along data and control dependence, with the variable that matters and the labels that flow.

``chains`` is (func, variable, def_block, use_block), ``control`` (func, src,
dst), places are (func, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept
from millrace.operators.fixpoint import closure


def pdg(chains: DataFrame, control: DataFrame) -> DataFrame:
    """(func, src, dst, kind, label): data dependences with their variable, control dependences with the branch taken."""
    data = chains.select("func", F.col("def_block").alias("src"), F.col("use_block").alias("dst"), F.lit("data").alias("kind"), F.col("variable").alias("label"))
    label = F.col("label") if "label" in control.columns else F.lit(None).cast("string")
    return data.unionByName(control.select("func", "src", "dst", F.lit("control").alias("kind"), label.alias("label"))).distinct()


def thin_slices(chains: DataFrame, computes: DataFrame, criteria: DataFrame) -> DataFrame:
    """(func, block, variable): the settings that the value of ``variable`` read at ``criteria`` (func, block, variable) is made of, each with the variable that it sets.

    ``computes`` (func, block, used, defined) says from which of the variables
    that a block reads it makes one that it sets; what it reads for other ends
    (as an address, a condition, an output) is not followed. Both the settings
    and the variables that matter grow until nothing is new.
    """
    made = chains.select("func", F.col("use_block").alias("at"), F.col("variable").alias("read"), F.col("def_block").alias("block"))
    # From one setting that matters straight to those that its value is made of.
    through = computes.select("func", F.col("block").alias("at"), F.col("used").alias("read"), F.col("defined").alias("variable")).distinct()
    steps = kept(through.join(made, ["func", "at", "read"]).select("func", F.col("at").alias("of"), F.col("variable").alias("for"), "block", F.col("read").alias("variable")).distinct())
    start = criteria.select("func", F.col("block").alias("at"), F.col("variable").alias("read")).join(made, ["func", "at", "read"]).select("func", "block", F.col("read").alias("variable"))
    return closure(start, lambda new: new.withColumnsRenamed({"block": "of", "variable": "for"}).join(steps, ["func", "of", "for"]).select("func", "block", "variable"))


READ, SET, RUNS = "read", "set", "runs"


def labelled(data: DataFrame, control: DataFrame, sources: DataFrame, carrying: DataFrame) -> DataFrame:
    """(func, block, what, label, implicit): where the labels of ``sources`` (func, block, label) arrive.

    ``data`` (func, src, dst): a value set at src is read at dst. ``carrying``
    (func, block): what is set there carries the labels of all that is read
    there, so labels of several operands unite; blocks that only compare, or
    that clean a value, are not in it. A label is implicit once it went through
    a decision: a block that reads it decides which of its control dependents
    run, what runs so carries it, and decides again. ``what`` is ``read``,
    ``set`` or ``runs``.
    """
    place = ["func", "block"]
    data = kept(data.select("func", F.col("src").alias("block"), "dst").distinct())
    control = kept(control.select("func", F.col("src").alias("block"), "dst").distinct())
    carrying = carrying.select(*place).distinct()
    row = lambda df, block, what, implicit: df.select("func", F.col(block).alias("block"), F.lit(what).alias("what"), "label", implicit.alias("implicit"))
    same, yes = F.col("implicit"), F.lit(True)

    def step(new: DataFrame) -> DataFrame:
        is_set, reads, runs = (new.where(F.col("what") == w) for w in (SET, READ, RUNS))
        read = row(is_set.join(data, place), "dst", READ, same)
        carried = row(reads.join(carrying, place, "left_semi"), "block", SET, same)
        decided = row(reads.unionByName(runs).join(control, place), "dst", RUNS, yes)
        return read.unionByName(carried).unionByName(decided).unionByName(row(runs, "block", SET, yes))

    return closure(row(sources, "block", SET, F.lit(False)), step)
