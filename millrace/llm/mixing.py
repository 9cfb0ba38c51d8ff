"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key; its leading 12 bits are the cell, a range of
keys, so cells sort each source by key without moving a row. Sums per source
and cell are pre-aggregated in the mappers; their running sums per source are
distributed prefix sums. A target of several epochs takes the source whole as
often as it goes in and, for the rest, rows in key order up to the exact
budget: cells below the cut whole, cells above it not at all. The cell at the
cut is divided by the next 12 bits in the same way, and only the rows of the
one small cell at the cut in it, about 1 in 2^24 of a source, are ordered one
by one. No other row takes part in a window.

Targets: sources by code point (null last) weigh ``weights`` in turn and share
the sum of all sizes; none exceeds ``most`` times its source's size, what is
over goes to the others by weight until all fit. The table of sources, one row
each, is ranked in one task: their number, not the corpus, is what it grows
with.

Defined cases: null or negative sizes count as 0; a row of size 0 takes 0;
rows that agree in all of id, text and size are taken in any order, which
gives the same rows; texts are read whole at any length; an empty table gives
an empty result; existing columns of the outputs' names are replaced, all
others kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.lineage import stored

CELLS = 12
WEIGHTS, MOST = (1, 2, 3), 3
SEED = 20_260


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(*columns: str) -> Column:
    return F.xxhash64(F.lit(SEED), *columns)


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) with ``target``: water filling, sources that reach ``most`` times their size first."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("w", weight).withColumn("full", F.col("size") * most)
    by_fill = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(everyone) - F.coalesce(F.sum("full").over(before), F.lit(0))
    heavy = F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / heavy)
    # The level is final from the first source that does not fill up; before it, sources are full.
    level = F.first(F.when(F.col("level") * F.col("w") <= F.col("full"), F.col("level")), ignorenulls=True).over(everyone)
    return levels.withColumn("final", level).select("source", "size", F.least(F.col("full").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("full").cast("double"))).alias("target"))


def _cuts(cells: DataFrame, budgets: DataFrame, at: str, room: str) -> DataFrame:
    """(of, ``at``, ``room``): of ``cells`` (of, cell, size) the one in which the running sum reaches the ``budget`` of its source, and what of it is left there."""
    before = F.sum("size").over(Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    known = cells.withColumn("before", before).join(budgets.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of")))
    reached = known.where("before < budget and budget <= before + size")
    return reached.select(F.col("of").alias("_of"), F.col("cell").alias(at), (F.col("budget") - F.col("before")).alias(room))


def mixed(docs: DataFrame, size: str = "size", source: str = "source", key: str = "key") -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (its source's) and ``taken``, the size the mix takes of each row over all epochs.

    ``docs`` has a ``size``, a ``source`` and a ``key`` from ``random_key``.
    """
    made = ["source_size", "target", "taken"]
    kept = [c for c in docs.columns if c.lower() not in made]
    # The user's row goes along as one struct, so that no name of ours can meet one of theirs.
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.col(source).alias("of"),
        F.col(key).alias("key"),
        F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.shiftrightunsigned(key, 64 - CELLS).alias("cell"),
        F.shiftrightunsigned(key, 64 - 2 * CELLS).bitwiseAND((1 << CELLS) - 1).alias("part"),
    )
    cells = stored(base.groupBy("of", "cell").agg(F.sum("size").alias("size")))
    wanted = targets(cells.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("size"))).withColumnRenamed("source", "of")
    whole = F.round("target").cast("long")
    plan = wanted.withColumn("epochs", F.when(F.col("size") > 0, F.floor(whole / F.col("size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", whole - F.col("epochs") * F.col("size")).withColumnRenamed("size", "source_size")
    cut = _cuts(cells, plan.select("of", "budget"), "cut", "room")
    plan = stored(plan.join(cut, F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of"))

    at_cut = plan.where("cut is not null").select(F.col("of").alias("_of"), "cut", F.col("room").alias("budget"))
    there = base.drop("row").join(at_cut, F.col("of").eqNullSafe(F.col("_of")) & (F.col("cell") == F.col("cut")), "left_semi")
    parts = there.groupBy("of", F.col("part").alias("cell")).agg(F.sum("size").alias("size"))
    small = _cuts(parts, at_cut.select(F.col("_of").alias("of"), "budget"), "small_cut", "small_room")
    plan = stored(plan.join(small, F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of")).withColumnRenamed("of", "_of")

    joined = base.join(plan, F.col("of").eqNullSafe(F.col("_of")), "left")
    once = F.col("epochs") * F.col("size")
    ordered = (F.col("cell") == F.col("cut")) & (F.col("part") == F.col("small_cut"))
    last = Window.partitionBy("of").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("small_room") - (F.sum("size").over(last) - F.col("size"))
    on_cut = joined.where(ordered).withColumn("taken", once + F.greatest(F.lit(0).cast("long"), F.least("size", left)))
    below = (F.col("cell") < F.col("cut")) | (F.col("cell") == F.col("cut")) & (F.col("part") < F.col("small_cut"))
    clear = joined.where(~F.coalesce(ordered, F.lit(False))).withColumn("taken", once + F.when(below, F.col("size")).otherwise(0))
    return clear.unionByName(on_cut).select("row.*", *made)


def copies(size: str = "size", taken: str = "taken") -> Column:
    """Times that a row stands in the mixed corpus: the cut falls after the row that reaches the budget; rows of size 0 cost nothing and stand once."""
    return F.when(F.col(size) > 0, F.ceil(F.col(taken) / F.col(size))).otherwise(1).cast("int")
