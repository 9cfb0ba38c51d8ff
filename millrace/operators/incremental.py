"""Keeping results current under additions and removals: snapshots, deltas, signed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored
from millrace.operators.fixpoint import closure


def classify(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): added, deleted, changed or unchanged, by the hash of ``content``."""
    a = old.select(key, F.xxhash64(content).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, F.xxhash64(content).alias("now"), F.lit(True).alias("in_new"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def apply_delta(rows: DataFrame, added: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``rows`` without the keys of ``removed`` and ``added``, and with ``added``."""
    gone = removed.select(key).unionByName(added.select(key)).distinct()
    return rows.join(gone, key, "left_anti").unionByName(added)


def merged_counts(state: DataFrame, delta: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """Totals by ``keys`` after a delta whose rows carry a ``sign`` of 1 or -1; groups that run empty go."""
    signed = delta.groupBy(*keys).agg(F.sum("sign").alias("n"), *(F.sum(F.col("sign") * F.col(s)).alias(s) for s in sums))
    both = state.select(*keys, "n", *sums).unionByName(signed)
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", *sums))).where("n > 0")


def reach_after(reached: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, node) as ``reached`` must be after ``edges`` (src, dst) lost ``removed`` and got ``added``, without a new run.

    ``reached`` holds what each of ``origins`` (origin, node) reached along
    ``edges``, itself included. First all rows that a removed edge may have
    carried are taken back; of these, those that another kept row still leads
    to come back, and what they lead to; added edges start from kept rows in
    the same way. Rows that no removed or added edge touches are never joined
    with edges, they are only compared with. An edge in both ``removed`` and
    ``added`` stays.
    """
    pair = ["origin", "node"]
    ends = lambda df: df.select(F.col("src").alias("node"), "dst").distinct()
    old, gone = stored(ends(edges)), stored(ends(removed).join(ends(added), ["node", "dst"], "left_anti"))
    now = stored(old.join(gone, ["node", "dst"], "left_anti").unionByName(ends(added)).distinct())
    step = lambda rows, along: rows.join(along, "node").select("origin", F.col("dst").alias("node"))
    reached, own = kept(reached.select(*pair)), origins.select(*pair).distinct()
    held = lambda rows: rows.join(reached, pair, "left_semi").join(own, pair, "left_anti")
    doubtful = stored(closure(held(step(reached.join(gone.select("node").distinct(), "node", "left_semi"), gone)), lambda new: held(step(new, old))))
    sure = stored(reached.join(doubtful, pair, "left_anti"))
    # Of doubtful rows, those with an edge from a sure one: edges into them, not out of all that is sure.
    into = now.select(F.col("node").alias("src"), F.col("dst").alias("node"))
    again = doubtful.join(into, "node").join(sure.withColumnRenamed("node", "src"), ["origin", "src"], "left_semi").select(*pair)
    fresh = step(sure.join(ends(added).select("node").distinct(), "node", "left_semi"), ends(added))
    start = again.unionByName(fresh).unionByName(own).distinct().join(sure, pair, "left_anti")
    back = closure(start, lambda new: step(new, now).distinct().join(sure, pair, "left_anti"))
    return sure.unionByName(back)
