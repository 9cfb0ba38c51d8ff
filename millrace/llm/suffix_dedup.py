"""Removal of long repeated byte strings, by hashes of what follows at sampled suffixes (not by sorting bucket identifiers; see the README).

Suffixes are sampled at anchors (see ``byte_anchors``): every ``LENGTH``-byte
window has one, at a place that only its bytes decide, so equal windows meet
at equal anchors. The refinement then runs over buckets of anchors only:

1. Initial buckets: anchors by the hash of the ``Q``-gram that starts there. A
   bucket of one is settled, its windows occur once.
2. Refinement by what follows at later offsets: the hash of all bytes that the
   anchor's run of windows covers (its hull). If all hulls of a bucket agree,
   so do all their windows. If some agree, those are settled alike, and one of
   each class goes on.
3. The classes of a bucket that still differ are refined at every offset, by
   the windows that start there. Small buckets meet in one task, a bounded
   number of hulls each; the windows of a crowded bucket are spread over all
   tasks and counted there, in stretches first.

Each step reuses the buckets of the step before and hands on only what those
left open. A window counts as repeated if its bytes also start anywhere else;
every byte that a repeated window covers goes. Buckets are equal in two 64-bit
hashes (gram, and hull or window) at once.

Defined cases: null text is the empty one; texts under ``LENGTH`` bytes lose
nothing; repeated rows are each other's copies; rows are told apart by id and
a 64-bit hash of their text, so null and repeated ids may be given; rows equal
in both count as copies of one text, up to collisions of that hash within one
id; ids may be of any type that Arrow holds; only ids and texts are read and
only ids and what was found returned, so other columns may have any names; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.lineage import discard, stored
from millrace.llm import byte_anchors as ba

#: Classes of a bucket up to which they meet in one task.
CROWD = 64
#: Windows of a stretch, in crowded buckets.
STEP = 16


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.array((squeeze(t.as_py() or b"") for t in texts), pa.binary())


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 31)


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(doc, code, at, gram, hull): id and hash of the text, the run's first window; the hull's last byte is the number of further windows."""

    def run(batches):
        for batch in batches:
            docs, codes = batch.column(0), batch.column(1)
            raw = (t.as_py() or b"" for t in batch.column(2))
            for data, pieces in ba.chunks(raw):
                a = ba.anchors(data, pieces)
                more = a["last"] - a["first"]
                hull = a["hull"] & ~np.uint64(255) | more.astype(np.uint64)
                text = pa.array(a["text"])
                columns = (a["first"].astype(np.int32), a["gram"].view(np.int64), hull.view(np.int64))
                yield pa.RecordBatch.from_arrays([docs.take(text), codes.take(text), *map(pa.array, columns)], ["doc", "code", "at", "gram", "hull"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc {kind}, code long, at int, gram long, hull long")


def _with_text(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Compressed texts joined with what is known of them, on id and text hash."""
    left = texts.select("doc", "code", _packed("raw").alias("packed"))
    right = lists.withColumnsRenamed({"doc": "_doc", "code": "_code"})
    return left.join(right, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("code") == F.col("_code")), how).drop("_doc", "_code")


def _hull_rows(joined: DataFrame) -> DataFrame:
    """A row for each class of an open bucket, with its hull's bytes."""
    kind = joined.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = _unpacked(row["packed"])
                out = [{"doc": row["doc"], "code": row["code"], **c, "hull": raw[c["at"] : c["at"] + c["more"] + ba.LENGTH]} for c in row["classes"]]
                yield pa.RecordBatch.from_pylist(out, schema=target)

    target = pa.schema([("doc", batch_type(joined.schema["doc"].dataType)), ("code", pa.int64()), ("at", pa.int32()), ("more", pa.int32()), ("gram", pa.int64()), ("alone", pa.bool_()), ("busy", pa.bool_()), ("hull", pa.binary())])
    return joined.mapInArrow(run, f"doc {kind}, code long, at int, more int, gram long, alone boolean, busy boolean, hull binary")


def batch_type(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def _windows(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with hulls: the row, the offset and the hash of each window."""
    rows, offsets, hashes = [], [], []
    first = 0
    hulls = table.column("hull").to_pylist()
    while first < len(hulls):
        size, end = 0, first
        while end < len(hulls) and size < ba.CHUNK:
            size += len(hulls[end])
            end += 1
        part = hulls[first:end]
        lengths = np.array(list(map(len, part)))
        starts = np.cumsum(lengths) - lengths
        n = lengths - ba.LENGTH + 1
        row = np.repeat(np.arange(len(part)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[row] + offset
        hashes.append(ba.mixed(ba.Hashes(np.frombuffer(b"".join(part), np.uint8)).of(begin, begin + ba.LENGTH)))
        rows.append(row + first)
        offsets.append(offset)
        first = end
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(hashes)


def _repeats_in(table: pa.Table) -> pa.RecordBatch:
    """Runs of repeated windows of the lone classes; all rows of a bucket are in ``table``."""
    row, offset, window = _windows(table)
    gram = table.column("gram").to_numpy()[row]
    order = np.lexsort((window, gram))
    same = (gram[order][1:] == gram[order][:-1]) & (window[order][1:] == window[order][:-1])
    hit = np.zeros(len(row), bool)
    hit[order] = np.append(False, same) | np.append(same, False)
    hit &= table.column("alone").to_numpy(zero_copy_only=False)[row]
    found = np.flatnonzero(hit)
    new = np.append(True, (np.diff(found) != 1) | (np.diff(row[found]) != 0)) if len(found) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(found)) - 1 if len(found) else start
    a, b = found[start], found[end] if len(found) else start
    doc, code = (table.column(c).combine_chunks().take(pa.array(row[a])) for c in ("doc", "code"))
    at = table.column("at").to_numpy()[row[a]] + offset[a].astype(np.int32)
    return pa.RecordBatch.from_arrays([doc, code, pa.array(at), pa.array((offset[b] - offset[a]).astype(np.int32))], ["doc", "code", "at", "more"])


def _small_buckets(hulls: DataFrame) -> DataFrame:
    kind = hulls.schema["doc"].dataType.simpleString()

    def run(batches):
        held = None  # the rows of a bucket that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
            if cut:
                yield _repeats_in(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield _repeats_in(held)

    return hulls.where("not busy").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, f"doc {kind}, code long, at int, more int")


def _lead(hull: bytes) -> int:
    """Place of the anchor in a hull."""
    grams = ba.mixed(ba.Hashes(np.frombuffer(hull, np.uint8, ba.LENGTH)).windows(ba.Q))
    return int(np.argmin(grams & ~ba.POSITION))


def _chunk_rows(hulls: DataFrame) -> DataFrame:
    """Hulls cut where the distance to the anchor is a multiple of ``STEP``, so that equal stretches are cut alike."""
    kind = hulls.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            docs, out = [], {"at": [], "more": [], "gram": [], "alone": [], "chunk": [], "hull": []}
            for i, row in enumerate(batch.to_pylist()):
                lead, hull, n = _lead(row["hull"]), row["hull"], row["more"] + 1
                hashes = ba.Hashes(np.frombuffer(hull, np.uint8))
                cuts = [0, *range(lead % STEP or STEP, n, STEP), n]
                for a, b in zip(cuts, cuts[1:]):
                    piece = hull[a : b - 1 + ba.LENGTH]
                    docs.append(i)
                    value = int(ba.mixed(hashes.of(np.array([a]), np.array([b - 1 + ba.LENGTH])) + np.uint64(lead - a + STEP))[0])
                    for key, v in (("at", row["at"] + a), ("more", b - 1 - a), ("gram", row["gram"]), ("alone", row["alone"]), ("chunk", value - (value >> 63 << 64)), ("hull", piece)):
                        out[key].append(v)
            if docs:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                take = pa.array(docs)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("code").take(take), *map(pa.array, out.values(), types)], ["doc", "code", *out])

    return hulls.where("busy").mapInArrow(run, f"doc {kind}, code long, at int, more int, gram long, alone boolean, chunk long, hull binary")


def _window_rows(chunks: DataFrame) -> DataFrame:
    kind = chunks.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, offset, window = _windows(batch)
                take = pa.array(row)
                at = batch.column("at").to_numpy()[row] + offset.astype(np.int32)
                doc, code, gram, alone = (batch.column(c).take(take) for c in ("doc", "code", "gram", "alone"))
                yield pa.RecordBatch.from_arrays([doc, code, pa.array(at), gram, alone, pa.array(window.view(np.int64))], ["doc", "code", "at", "gram", "alone", "window"])

    return chunks.mapInArrow(run, f"doc {kind}, code long, at int, gram long, alone boolean, window long")


def _crowded_buckets(hulls: DataFrame) -> DataFrame:
    """First by stretches of up to ``STEP`` windows, then, where those differ, by single windows; a stretch of many is kept once as a witness."""
    chunks = stored(_chunk_rows(hulls))
    shared = stored(chunks.groupBy("gram", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc", "code", "at")).alias("one")).where("n > 1").drop("n"))
    joined = stored(chunks.join(shared, ["gram", "chunk"], "left"))
    discard(chunks)
    settled = joined.where("alone and one is not null").select("doc", "code", "at", "more")
    witness = F.struct("doc", "code", "at").eqNullSafe(F.col("one"))
    going = joined.where(F.col("one").isNull() | witness).select("doc", "code", "at", "more", "gram", (F.col("alone") & F.col("one").isNull()).alias("alone"), "hull")
    spread = stored(_window_rows(going))
    often = stored(spread.groupBy("gram", "window").count().where("count > 1").drop("count"))
    return settled.unionByName(spread.where("alone").join(often, ["gram", "window"]).select("doc", "code", "at", F.lit(0).alias("more")))


def repeated_runs(texts: DataFrame) -> DataFrame:
    """(doc, code, at, more): runs of repeated windows of (doc, code, raw); ``at``: the first window, ``more``: further ones."""
    anchors = _anchor_rows(texts)
    buckets = stored(anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("hull").alias("low"), F.max("hull").alias("high")).where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("open")))
    more = F.col("hull").bitwiseAND(255).cast("int")
    met = stored(anchors.join(buckets, "gram").select("doc", "code", "at", more.alias("more"), *(F.when(F.col("open"), F.col(c)).alias(c) for c in ("gram", "hull"))))
    discard(buckets)
    settled = met.where("gram is null").select("doc", "code", "at", "more")

    left = met.where("gram is not null")
    classes = stored(left.groupBy("gram", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc", "code", "at")).alias("one")))
    agreed = left.join(classes.where("n > 1").select("gram", "hull"), ["gram", "hull"]).select("doc", "code", "at", "more")

    sizes = stored(classes.groupBy("gram").agg((F.count("*") > CROWD).alias("busy"), F.min("n").alias("least")).where("least = 1").drop("least"))
    going = classes.join(sizes, "gram").select("gram", F.col("one.doc").alias("doc"), F.col("one.code").alias("code"), F.col("one.at").alias("at"), more.alias("more"), (F.col("n") == 1).alias("alone"), "busy")
    lists = going.groupBy("doc", "code").agg(F.collect_list(F.struct("at", "more", "gram", "alone", "busy")).alias("classes"))
    hulls = stored(_hull_rows(_with_text(texts, lists, "inner")))
    return settled.unionByName(agreed).unionByName(_small_buckets(hulls)).unionByName(_crowded_buckets(hulls))


_SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.arrow_udf(T.StructType([T.StructField("removed", T.ArrayType(_SPAN)), T.StructField("kept", T.BinaryType())]))
def _cut(packed: pa.Array, runs: pa.Array) -> pa.Array:
    removed, kept = [], []
    for p, r in zip(packed, runs):
        raw, out, last, spans = _unpacked(p.as_py()), [], 0, []
        if r.is_valid:
            begin = r.values.field("at").to_numpy()
            end = begin + r.values.field("more").to_numpy() + ba.LENGTH
            order = np.argsort(begin, kind="stable")
            begin, reach = begin[order], np.maximum.accumulate(end[order])
            new = np.append(True, begin[1:] > reach[:-1])
            spans = list(zip(begin[new].tolist(), reach[np.append(new[1:], True)].tolist()))
        for a, b in spans:
            out.append(raw[last:a])
            last = b
        kept.append(b"".join([*out, raw[last:]]))
        removed.append([{"begin": a, "end": b} for a, b in spans])
    return pa.StructArray.from_arrays([pa.array(removed, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["removed", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``removed`` (maximal byte spans) and ``kept`` (the bytes left) for each row of ``docs``."""
    whole = F.coalesce(text, F.lit(""))
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(whole).alias("code"), whole.cast("binary").alias("raw"))
    runs = repeated_runs(texts).groupBy("doc", "code").agg(F.collect_set(F.struct("at", "more")).alias("runs"))
    joined = _with_text(texts, runs, "left")
    cut = joined.select(F.col("doc").alias("id"), _cut("packed", "runs").alias("cut")).select("id", "cut.*")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("id", (F.octet_length("kept") + gone).alias("n_bytes"), "removed", "kept")
