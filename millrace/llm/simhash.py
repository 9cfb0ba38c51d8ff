"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

A fingerprint is cut into four 16-bit blocks. Two that differ in at most two
bits differ in at most two blocks, so at least two blocks agree: the six pairs
of blocks are the first keys (32 bits each). What shares one has at most two
differing bits in the 32 bits left, which are cut into four blocks of 8 in the
same way, and what is left of those into four of 4: three levels of pigeonholes
whose keys agree in 56 bits. A key of the last level holds at most 256 different
fingerprints by its making, in a corpus of any size and with near copies in any
number; those are joined and their Hamming distance is verified. Each level
goes on only with what has company in the level before. Exact copies have one
fingerprint and are counted before any join.

Defined cases: null text is empty; a text without words has fingerprint zero
and links like any other; fewer words than a shingle form one; very long texts
are read whole; repeated rows stay; rows with a null id take the smallest id of
their component, null if it has none; an empty table gives an empty result.
Ids may be of any type that orders. Only the columns of ids and texts are read,
so others may have any names.

Fingerprints further apart, where blocks that must agree would be too short to
tell anything, are looked for in sorted tables (``neighbours``): the bits are
turned round several times, each table is sorted, and each fingerprint is held
against the next few. This costs the same for each, whatever groups there are,
and finds pairs by chance: a caller that may lose none has to complete them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import discard, stored
from millrace.operators.components import connected_components

WORDS, SEED, NEAR = 3, 42, 2
#: Bits of a block at each level of pigeonholes; four blocks a level.
LEVELS = (16, 8, 4)
#: Hashes whose bits are counted at once.
SLICE = 1 << 14
#: Sorted tables, and how many that follow each is held against.
TURNS, NEXT = 8, 4


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where over half of the hashes have them, signed; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        some = hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(raw: bytes) -> int:
    """The fingerprint of UTF-8 text, as a signed 64-bit number."""
    words = raw.lower().split()  # on bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(WORDS))) if len(words) >= WORDS else [words]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(s), SEED) for s in shingles], "<u8"))


@F.arrow_udf(T.LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    return pa.array((simhash(t.as_py() or b"") for t in texts), pa.int64())


def fingerprint(text: str | Column = "text") -> Column:
    """The 64-bit fingerprint of ``text``, as a long."""
    return _simhash((F.col(text) if isinstance(text, str) else text).cast("binary"))


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _keys(rest: str, bits: int) -> Column:
    """Six structs for the low ``4 * bits`` bits of ``rest``: ``pair``, the two blocks under the pair's number, and ``rest``, the other two."""
    block = [F.shiftrightunsigned(rest, bits * i).bitwiseAND((1 << bits) - 1) for i in range(4)]

    def joined(i: int, j: int) -> Column:
        return F.shiftleft(block[i], bits).bitwiseOR(block[j])

    pairs = [(i, j) for i in range(4) for j in range(i)]
    others = [tuple({0, 1, 2, 3} - set(p)) for p in pairs]
    return F.array(*(F.struct(F.lit(k << 2 * bits).cast("long").bitwiseOR(joined(*p)).alias("pair"), joined(*o).alias("rest")) for k, (p, o) in enumerate(zip(pairs, others))))


def close_pairs(fps: DataFrame) -> DataFrame:
    """Edges (a, b) of all fingerprints of column ``fp`` within two bits of each other; ``fps`` holds each fingerprint once."""
    held = fps.select("fp", F.col("fp").alias("rest"))
    keys: list[str] = []
    for level, bits in enumerate(LEVELS):
        key = f"key{level}"
        held = held.withColumn("k", F.explode(_keys("rest", bits))).select("fp", *keys, F.col("k.pair").alias(key), F.col("k.rest").alias("rest"))
        keys.append(key)
        if level == 0:
            # Most fingerprints have no company: they go no further.
            shared = held.groupBy(key).count().where("count > 1").select(key)
            held = stored(held.join(shared, key))
    left = held.select(*keys, F.col("fp").alias("a"))
    met = left.join(held.select(*keys, F.col("fp").alias("b")), keys)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR
    return met.where(F.col("a") < F.col("b")).where(near).select("a", "b")


def _held_against_next(near: int):
    """A function on sorted batches (turn, turned, node): (a, b) of nodes up to ``NEXT`` places and ``near`` bits apart."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in ("i4", "i8", "i8")]
        for batch in batches:
            turn, turned, node = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            known, a, b = len(held[0]), [], []
            for d in range(1, NEXT + 1):
                later = np.arange(max(known, d), len(node))
                close = (turn[later] == turn[later - d]) & (np.bitwise_count((turned[later] ^ turned[later - d]).view("u8")) <= near)
                a.append(node[later - d][close])
                b.append(node[later][close])
            yield pa.RecordBatch.from_arrays([np.concatenate(a), np.concatenate(b)], ["a", "b"])
            held = [x[-NEXT:] for x in (turn, turned, node)]

    return pairs


def neighbours(fps: DataFrame, near: int) -> DataFrame:
    """Pairs (a, b), a < b, of ``node`` (longs) whose fingerprints ``fp`` are neighbours in a sorted table and at most ``near`` bits apart.

    Of nodes with one fingerprint each meets the next. Which pairs are found
    also depends on where the sorted tables are cut into tasks.
    """
    width = 64 // TURNS
    turns = [F.struct(F.lit(i).alias("turn"), F.shiftleft("fp", width * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - width * i) if i else F.lit(0)).alias("turned")) for i in range(TURNS)]
    tables = fps.select("node", F.explode(F.array(*turns)).alias("t")).select("t.turn", "t.turned", "node")
    order = ("turn", "turned", "node")
    met = tables.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_held_against_next(near), "a long, b long")
    return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """(fp, first): for each distinct fingerprint of (id, fp) its component's smallest id.

    ``id`` may be any type that orders, a struct included.
    """
    alone = stored(prints.groupBy("fp").agg(F.min("id").alias("id")))
    linked = alone.join(stored(connected_components(close_pairs(alone.select("fp")))).withColumnRenamed("node", "fp"), "fp")
    firsts = linked.groupBy("root").agg(F.min("id").alias("first"))
    told = linked.join(firsts, "root").select("fp", "first")
    return alone.join(told, "fp", "left").select("fp", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first")).alias("first"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component): a row for each row of ``docs``; component: the smallest id reachable over close fingerprints."""
    prints = stored(docs.select(F.col(doc_id).alias("id"), fingerprint(text).alias("fp")))
    return prints.join(grouped(prints).withColumnRenamed("first", "component"), "fp").select("id", "fp", "component")
