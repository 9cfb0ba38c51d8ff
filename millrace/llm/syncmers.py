"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a string over words; where a script writes none, each of its letters
is a word. Of its k-mers (k = 3 words) those are chosen whose least inner
substring (s = 1 word, by hash) lies at an edge. Whether a k-mer is chosen
depends on nothing outside it, so an edit changes the choice only where it
touches a k-mer: ``with_anchors`` keeps hashes and places.

Texts are matched by position: each anchor is tied to the next one by the
distance between their places, and the hash of both and the distance is a mark
of the text (``with_marks``). A mark is shared only where two texts have the
same anchors in the same order at the same distance, wherever that stands in
either; the likeness counts all marks, none are sampled. The fingerprint is a
digest of them: the least ``SIZE``.

Defined cases: null text is the empty one; a text of one or two words is one
anchor, a text without words none; a lone anchor is its own mark; a text
without marks is like another such (1.0) and unlike all else (0.0). Equal texts
have equal fingerprints. Very long texts are read whole, repeated rows stay, an
empty table gives an empty result, other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.names import free

K, SIZE = 3, 64
#: Blanks, and the place after a letter of a script without them.
BLANK = r"[\x20\x09-\x0D]+|(?<=[\u2E80-\u9FFF\uAC00-\uD7AF])"
#: Ranges of ids in which neighbours are found; their bounds are the only thing brought to the driver.
MOST_RANGES = 1024


def _with_word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")
    return df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))


def _kmers(hashes: str) -> Column:
    """array<struct<a, b, c>> of all runs of three word hashes."""
    n = F.size(hashes) - (K - 1)
    return F.arrays_zip(*(F.slice(hashes, F.lit(i + 1), n).alias(c) for i, c in enumerate("abc")))


def _closed(m: Column) -> Column:
    return (m["b"] >= m["a"]) | (m["b"] >= m["c"])


def _hash(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 24)


def with_anchors(df: DataFrame, text: str = "text", out: str = "anchors") -> DataFrame:
    """``df`` with array<struct<at, hash>>: the chosen k-mers and their first words' numbers."""
    (hashes,) = free(df, "hashes")
    hashed = _with_word_hashes(df, text, hashes)
    marked = F.transform(_kmers(hashes), lambda m, i: F.struct(i.alias("at"), _closed(m).alias("closed"), _hash(m["a"], m["b"], m["c"]).alias("hash")))
    chosen = F.transform(F.filter(marked, lambda m: m["closed"]), lambda m: F.struct(m["at"].alias("at"), m["hash"].alias("hash")))
    whole = F.array(F.struct(F.lit(0).alias("at"), _hash(F.array_join(hashes, " ")).alias("hash")))
    short = F.when(F.size(hashes) > 0, whole).otherwise(F.slice(whole, 1, 0))
    return hashed.withColumn(out, F.when(F.size(hashes) >= K, chosen).otherwise(short)).drop(hashes)


def with_marks(df: DataFrame, text: str = "text", out: str = "marks") -> DataFrame:
    """``df`` with array<long>: the distinct marks of ``text``, in order."""
    (anchors,) = free(df, "anchors")
    found = with_anchors(df, text, anchors)
    follow = F.slice(anchors, 2, F.greatest(F.size(anchors) - 1, F.lit(0)))
    tied = F.zip_with(F.slice(anchors, 1, F.greatest(F.size(anchors) - 1, F.lit(0))), follow, lambda x, y: _hash(x["hash"], y["hash"], y["at"] - x["at"]))
    alone = F.transform(anchors, lambda x: x["hash"])
    return found.withColumn(out, F.array_distinct(F.when(F.size(anchors) > 1, tied).otherwise(alone))).drop(anchors)


def as_text(marks: str) -> Column:
    """The fingerprint: the least ``SIZE`` marks, ten hex digits each."""
    least = F.slice(F.sort_array(marks), 1, SIZE)
    return F.lower(F.array_join(F.transform(least, lambda h: F.lpad(F.hex(h), 10, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Share of common marks (Dice), 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def _range_of(bounds: list, column: str) -> Column:
    """Number of the range, ascending as ids descend, found by halving; null ids have the last."""
    if not bounds:
        return F.when(F.col(column).isNull(), 1).otherwise(0)
    table = F.array(*map(F.lit, bounds))
    ends = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))  # the number of bounds up to the id

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(table, middle) <= F.col(column)
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high")))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    found = F.aggregate(steps, ends, halve)["low"]
    return F.when(F.col(column).isNull(), len(bounds) + 1).otherwise(len(bounds) - found)


def with_next(df: DataFrame, order: str, columns: list[str], tie: str) -> DataFrame:
    """``df`` with ``next_<column>`` of the following row by descending ``order`` (a number; null last), ties by ``tie``; the first follows the last.

    Ranges of ids are windows of their own; each also holds, marked, the first
    row of the range after it. Only the bounds, at most ``MOST_RANGES``
    quantiles, pass through the driver.
    """
    spark = df.sparkSession
    at, guest, of, first, earlier = free(df, "range", "guest", "of", "first", "earlier")
    n = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0]
    ranged = df.withColumn(at, _range_of(sorted(set(quantiles or [])), order))
    firsts = ranged.groupBy(at).agg(F.max(order).alias(first))
    every = Window.orderBy(at)
    before = F.coalesce(F.lag(at).over(every), F.max(at).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = firsts.select(F.col(at).alias(of), first, before.alias(earlier))  # a row for each range
    guests = ranged.join(F.broadcast(links), (F.col(at) == F.col(of)) & F.col(order).eqNullSafe(F.col(first))).withColumn(at, F.col(earlier))
    both = ranged.withColumn(guest, F.lit(0)).unionByName(guests.drop(of, first, earlier).withColumn(guest, F.lit(1)))
    w = Window.partitionBy(at).orderBy(guest, F.col(order).desc_nulls_last(), tie)
    led = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return led.where(f"`{guest}` = 0").drop(guest, at)
