"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

A text's features are the n-grams (3 to 5 characters, lower case, a space at
either end) that occur in it, hashed to 2^20 buckets. For each bucket the ratio
of its smoothed share among the toxic to that among the other rows scales the
feature; a logistic regression on the scaled features gives the weights.

Only the fit looks at a sample: of the labelled rows that may be learnt from,
``SAMPLE`` of each class at most, those whose ids hash lowest, one row an id.
Spark counts their buckets; the driver gets the counts (2^20 rows at most) and,
of each sampled row, the buckets that were chosen as features, whatever the
lengths of texts. The share of toxic rows, from all labels, then corrects the
intercept. The weights, 4 MB at any corpus size, are broadcast, and every whole
text is scored.

Defined cases: null text is the empty one, which has no n-grams and scores the
intercept; labels repeated for an id count once, toxic if any says so; null
labels and labels without a document are ignored; without labels of both
classes the score is the share of toxic ones, 0 if there are no labels; of rows
that share an id the fit sees the text whose hash is least; an empty table gives
an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import discard, stored

GRAMS, BITS = (3, 4, 5), 20
#: Labelled rows of each class that the fit sees at most.
SAMPLE = 1500
ROUNDS, PENALTY, SMOOTH = 60, 1e-3, 1.0
#: Standard errors by which a bucket's share of toxic and of other rows must differ to be a feature.
CLEAR = 5.0
#: Texts of an Arrow batch of features, which are some ten times as wide.
BATCH = 64
#: From this score on a text counts as toxic.
TOXIC = 0.3

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def buckets(text: str) -> np.ndarray:
    """Buckets of all n-grams of ``text``, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], codes
    for n in range(2, GRAMS[-1] + 1):
        if len(codes) < n:
            break
        h = h[:-1] * _STEP + codes[n - 1 :]
        if n >= GRAMS[0]:
            mix = (h ^ (h >> np.uint64(31))) * _FINISH
            out.append((mix >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class _Distinct:
    """One place of each bucket in an array of buckets."""

    def __init__(self):
        self.owner = np.zeros(1 << BITS, np.int32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        places = np.arange(len(ids), dtype=np.int32)
        self.owner[ids] = places
        return ids[self.owner[ids] == places]


_distinct: list[_Distinct] = []


def features(text: str | None) -> np.ndarray:
    if not _distinct:
        _distinct.append(_Distinct())
    return _distinct[0](buckets(text or ""))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array((features(t.as_py()) for t in texts), pa.list_(pa.int32()))


def ratios(with_: np.ndarray, without: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The log-count ratio of each bucket that ``with_`` of ``n1`` toxic and ``without`` of ``n0`` other rows have; 0 for those that are no feature."""
    ratio = np.log((with_ + SMOOTH) / (with_ + SMOOTH).sum()) - np.log((without + SMOOTH) / (without + SMOOTH).sum())
    # Buckets whose share of rows differs between the classes by chance are left out.
    share_of = (with_ + without) / (n1 + n0)
    spread = np.sqrt(np.maximum(share_of * (1 - share_of), 1e-12) * (1 / n1 + 1 / n0))
    ratio[np.abs(with_ / n1 - without / n0) < CLEAR * spread] = 0
    return ratio


def fit(rows: list[np.ndarray], toxic: np.ndarray, share: float, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the intercept, from the features and labels of the sample and ``ratios``."""
    size = 1 << BITS
    live = np.flatnonzero(ratio)
    column = np.full(size, -1, np.int32)
    column[live] = np.arange(len(live))
    found = [c[c >= 0] for c in (column[ids] for ids in rows)]
    row = np.repeat(np.arange(len(rows)), list(map(len, found)))
    col = np.concatenate(found)
    value = ratio[live][col]
    # Each class weighs half; steps are scaled by each column's size (diagonal curvature).
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    curve = np.bincount(col, weight[row] * value**2 / 4, len(live)) * len(live) ** 0.5 + PENALTY
    beta, intercept, speed, lean = np.zeros(len(live)), 0.0, np.zeros(len(live)), 0.0
    for _ in range(ROUNDS):
        margin = np.bincount(row, value * beta[col], len(rows)) + intercept
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - toxic)
        speed = 0.9 * speed - 0.3 * (np.bincount(col, error[row] * value, len(live)) + PENALTY * beta) / curve
        lean = 0.9 * lean - 0.3 * error.sum()
        beta, intercept = beta + speed, intercept + lean
    out = np.zeros(size, np.float32)
    out[live] = beta * ratio[live]
    return out, float(intercept + np.log(share / (1 - share)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Weights and intercept learnt from ``labels`` (doc_id, toxic) outside the held-out rows."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    some = [usable.where(F.col("toxic") == v).orderBy(*order).limit(SAMPLE) for v in (0, 1)]
    sample = some[0].unionByName(some[1]).withColumnsRenamed({"doc_id": "_id", "toxic": "_toxic"})
    # At most 2 * SAMPLE ids, whatever the tables' sizes.
    text_hash = F.xxhash64(F.coalesce(text, F.lit("")))
    met = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), text_hash.alias("_h")).join(F.broadcast(sample), "_id")
    one = met.groupBy("_id", "_toxic").agg(F.min_by("_text", "_h").alias("_text"))
    known = stored(one.select("_id", "_toxic", _features("_text").alias("_f")), BATCH)
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(1 << BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    with_, without = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in known.select("_toxic", F.explode("_f").alias("_b")).groupBy("_b").agg(F.sum("_toxic").alias("w"), F.count("*").alias("n")).toLocalIterator():
        with_[r["_b"]], without[r["_b"]] = r["w"], r["n"] - r["w"]
    ratio = ratios(with_, without, sizes[1], sizes[0])
    live = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    @F.arrow_udf(T.BinaryType())
    def chosen(lists: pa.Array) -> pa.Array:
        found = (x.values.to_numpy() for x in lists)
        return pa.array((ids[live.value[ids]].tobytes() for ids in found), pa.binary())

    narrow = stored(known.select("_id", "_toxic", chosen("_f").alias("_f")), BATCH)
    rows = sorted(narrow.collect(), key=lambda r: r["_id"])
    discard(known)
    discard(narrow)
    return fit([np.frombuffer(r["_f"], np.int32) for r in rows], np.array([r["_toxic"] for r in rows], int), share, ratio)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    intercept = model[1]

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        w = weights.value
        margins = np.array([float(np.sort(w[features(t.as_py())]).sum(dtype=np.float64)) for t in texts]) + intercept
        return pa.array(1 / (1 + np.exp(-np.clip(margins, -40, 40))))

    return docs.withColumn(out, score(F.col(text)))
