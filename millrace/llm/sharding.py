"""Sharding by sampled splitters: shards of near equal bytes, cut out of one order of the rows.

Rows are ordered by a hash of their group (equal texts), then of all their
columns but maps, so that a shard is a random mix and a group lies together. Splitters
come from a sample in which a row is drawn the more often the larger it is:
its weight is its share of the bytes plus its share of the rows. Quantiles of
the sample cut the order into many ranges, at the edges of groups; ranges that
turn out overfull, as one large group makes them, are sampled again by
themselves and subdivided inside the group, until none is left or nothing
divides it further. Bytes and rows are then counted exactly in every range,
and the sums before each range are known from these counts; inside a range one
sort gives each row its place. A row goes to the shard in which the middle of
its bytes falls, a group of at most ``TOGETHER`` of a shard goes as a whole,
so only a larger group, or one that weighs as much by its rows, is divided.

Only counts of ranges and their splitters reach the driver: one range for
``ROWS`` rows, or ``RANGES`` to a shard, and those that dividing adds. No task holds more than the rows of
its ranges.

Defined cases: null or negative sizes count as 0; a null group is a group;
repeated rows are told apart by their place in the stored table, which gives
the same rows in any order; ties in a hash order by the next one; texts are
never cut and never read here; an empty table gives an empty result; existing
``shard`` and ``slot`` are replaced, all other columns are kept whatever their
names. Reruns agree row for row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import discard, stored

#: Ranges to a shard, rows to a range on average at most, draws to a range.
RANGES, ROWS, DRAWS = 64, 1_000_000, 16
#: Rows to a range on average at least, but for one range to a shard.
LEAST = 64
#: A group of this share of a shard's bytes stays whole; a cut moves by half of that at most.
TOGETHER = 0.01
#: A range is overfull if it weighs as much as so many average ones.
OVERFULL = 3.0
#: Hexadecimal digits of one part of the order, which has three.
_PART = 16


def _ordered(hash_: Column) -> Column:
    return F.lpad(F.hex(hash_), _PART, "0")


def _range_of(bounds: list[str], key: str) -> Column:
    """The number of ``bounds`` at or before the key: a binary search in each task."""
    held = np.array(bounds, dtype=f"S{3 * _PART}")

    @F.arrow_udf(T.IntegerType())
    def search(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(held, np.array(keys.to_pylist(), dtype=held.dtype), side="right").astype("int32"))

    return search(F.col(key))


def _splitters(weighed: DataFrame, step: float, salt: int, width: int) -> list[str]:
    """Keys at every ``DRAWS``-th draw, where a row is drawn once for each ``step`` of its ``weight`` and, by chance, for what remains; the first ``width`` digits only."""
    chance = (F.xxhash64("key", F.lit(salt)).cast("double") / 2.0**64) + 0.5
    drawn = weighed.select("key", F.floor(F.col("weight") / step + chance).alias("draws")).where("draws > 0")
    before = F.sum("draws").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("draws")
    # The sample holds DRAWS keys to a range, whatever the number of rows.
    ends = drawn.select("key", "draws", before.alias("before")).where(F.floor((F.col("before") + F.col("draws")) / DRAWS) > F.floor(F.col("before") / DRAWS))
    return [r[0].ljust(3 * _PART, "0") for r in ends.select(F.substring("key", 1, width)).distinct().collect()]


def _ranges(base: DataFrame, shards: int) -> tuple[list[str], dict[int, tuple[int, int]], int]:
    """Splitters in order, (size, rows) of each range, and the size of all."""
    total, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = max(shards, min(RANGES * shards, count // LEAST), -(-count // ROWS))
    weight = F.col("size") / max(total, 1) + F.lit(1.0 / max(count, 1))
    mean = 2.0 / wanted
    bounds: set[str] = set(_splitters(base.select("key", weight.alias("weight")), mean / DRAWS, 0, _PART)) if count else set()
    for salt in range(1, 64):
        held = sorted(bounds)
        ranged = base.withColumn("range", _range_of(held, "key"))
        counts = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        heavy = [k for k, (size, n) in counts.items() if n > 1 and size / max(total, 1) + n / count > OVERFULL * mean]
        if not heavy:
            break
        inside = ranged.where(F.col("range").isin(heavy))
        for width in (_PART, 3 * _PART):  # between groups first, then inside of them
            found = set(_splitters(inside.select("key", weight.alias("weight")), mean / DRAWS, salt, width)) - bounds
            if found:
                break
        if not found:  # what is left is a row as large as ranges, which nothing divides
            break
        bounds |= found
    return held, counts, total


def sharded(rows: DataFrame, size: str = "size", group: str = "group", shards: int = 8) -> DataFrame:
    """``rows`` with ``shard``, from 0, and ``slot``, gapless from 0 in each shard."""
    made = ["shard", "slot"]
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in made]
    hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if c.lower() not in made and "map<" not in kind]
    key = F.concat(_ordered(F.xxhash64(F.lit("group"), group)), _ordered(F.xxhash64(F.lit("row"), *hashed)), _ordered(F.monotonically_increasing_id()))
    # The user's row goes along as one struct, so that no name of ours can meet one of theirs.
    base = stored(rows.select(F.struct(*kept).alias("row"), F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("size"), key.alias("key")))
    bounds, counts, total = _ranges(base, shards)
    before, rank, starts = 0, 0, []
    for k in sorted(counts):
        starts.append((k, before, rank))
        before, rank = before + counts[k][0], rank + counts[k][1]
    known = base.sparkSession.createDataFrame(starts, "of int, before long, rank long")
    placed = base.withColumn("range", _range_of(bounds, "key")).join(F.broadcast(known), F.col("range") == F.col("of"))
    by_key = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    mates = Window.partitionBy("range", F.substring("key", 1, _PART))
    ends = placed.withColumns({"end": F.col("before") + F.sum("size").over(by_key), "at": F.col("rank") + F.row_number().over(by_key) - 1})
    joint = ends.withColumns({"mates": F.sum("size").over(mates), "last": F.max("end").over(mates)})
    together = F.col("mates") <= int(TOGETHER * total / shards)
    # Twice the middle, so that all of it is whole numbers.
    middle = F.when(together, 2 * F.col("last") - F.col("mates")).otherwise(2 * F.col("end") - F.col("size"))
    shard = F.expr(f"CAST(least({shards - 1}, (middle * {shards}) div {max(2 * total, 1)}) AS INT)")
    dealt = stored(joint.withColumn("middle", middle).select("row", "at", shard.alias("shard")))
    firsts = dict(dealt.groupBy("shard").agg(F.min("at")).collect())
    first = F.element_at(F.create_map(*(F.lit(x) for pair in firsts.items() for x in pair)), F.col("shard")) if firsts else F.lit(0)
    discard(base)
    return dealt.select("row.*", "shard", (F.col("at") - first).alias("slot"))


def written(dealt: DataFrame, path: str, files: int) -> None:
    """Parquet folders ``shard=0``, ``shard=1``, ... of about ``files`` files in all, rows by ``slot``."""
    dealt.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
