"""Conversation repair: the cheapest edits that give roles the order ``(s?(ua)+)?``, by a forward Viterbi pass.

Four grammar states say what was given out last: nothing, the system's turn,
the user's, the assistant's. The pass carries for each state the least (cost,
audit string); a row is kept, given the other role or deleted, and after each
row its layer is closed with at most two insertions, since a third never pays.
Of equal costs the least audit string wins. Two strings of one layer, state
and cost are never prefixes of one another, as each has one letter a row and
insertions cost, so what is least stays least whatever follows.

The pass is a product of matrices (state before, state after), and products
can be grouped. So rows are range-partitioned by conversation and turn and
sorted; each task streams its partition in segments of at most ``ROWS`` rows
and ``BYTES`` of text, and gives one matrix for each. A conversation of any
length is spread over as many tasks as it has rows for. The matrices of a
conversation, one for each segment, are then multiplied in order; the way back
tells each segment its states, hence its edits and its part of the repaired
text. Equal rows of a conversation are one row with a count before anything is
shuffled twice. Only the digest of a conversation's repaired text, which is one
sequential hash, and the audit string, which is one value, go through one task
a conversation, in segments of bounded size.

Defined cases: rows of one turn are ordered by role and text; a null turn
comes first; null roles and texts are one space; a null conversation is a
conversation; repeated rows are duplicates; a row without one of the three
roles' initials is given a role or deleted; empty and very long texts as any
other; a conversation without rows costs nothing; an empty table gives an
empty result; further columns are dropped, so none clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import discard, stored

ROWS, BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: What an undeleted row adds whose text breaks off.
TRUNCATED = 1

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: State: what may follow, by initial.
_NEXT = {_START: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
_FINAL = (_START, _ASSISTANT)

Layer = dict[int, tuple[int, str]]


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    if state not in layer or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def closed(layer: Layer) -> Layer:
    """``layer`` with at most two insertions after each of its states."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            for follower in _NEXT[state].values():
                if follower in _ROLES:
                    _better(layer, follower, cost + INSERT, audit + "I")
    return layer


def stepped(layer: Layer, initial: str, drop: bool, truncated: bool, times: int = 1) -> Layer:
    """The layer after one row; ``drop`` if it must go, ``times`` for a row that is followed by equal ones, which must go."""
    out: Layer = {}
    more = times - 1
    for state, (cost, audit) in layer.items():
        _better(out, state, cost + DELETE * times, audit + "D" * times)
        if not drop:
            for letter, follower in _NEXT[state].items():
                if letter == initial:
                    _better(out, follower, cost + KEEP + TRUNCATED * truncated + DELETE * more, audit + "K" + "D" * more)
                elif follower in _ROLES:
                    _better(out, follower, cost + REROLE + TRUNCATED * truncated + DELETE * more, audit + "R" + "D" * more)
    return closed(out)


def repaired(rows: list[tuple[str, str, int]], state: int, audit: str) -> Iterator[str]:
    """``role:text`` of what ``audit`` leaves of ``rows`` (role, text, times) after ``state``."""
    each = ((role, text) for role, text, times in rows for _ in range(times))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(each)
        if edit == "D":
            continue
        if edit != "K":
            role = _ROLES[next(f for f in _NEXT[state].values() if f in _ROLES)]
        state = _NEXT[state][role[:1]]
        yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): ``rows`` with nulls as one space, damaged by crc32 of ``conv_id:turn`` modulo 20; rows that equal one another counted."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"), kind.alias("kind")).where("kind > 0")
    return hurt.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` from ``damaged`` with ``said``, a digest of role and text, and what is wrong with them: ``blank``, ``seen`` (equal to a row of an earlier turn), ``truncated``."""
    told = rows.withColumn("said", F.sha2(F.concat_ws("\n", F.sha2("role", 256), "text"), 256))
    first = told.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"))
    met = told.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")))
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    whole = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    return met.select("conv_id", "turn", "role", "text", "times", "said", blank.alias("blank"), (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"), (~whole).alias("truncated"))


def _matrix(rows: list[tuple], sources: tuple[int, ...]) -> list[dict]:
    """Least cost and audit of ``rows`` (role, text, times, drop, truncated) from each of ``sources`` to each state."""
    out = []
    for source in sources:
        layer = closed({source: (0, "")})
        for role, _, times, drop, truncated in rows:
            layer = stepped(layer, role[:1], drop, truncated, times)
        out += [{"source": source, "target": t, "cost": c, "audit": a} for t, (c, a) in layer.items()]
    return out


_LEGAL = {"su", "ua", "au"}
_SEGMENT = "nth long, first string, last string, illegal long, edges array<struct<source: int, target: int, cost: long, audit: string>>, rows array<struct<role: string, text: string, times: long>>"
_EDGES = pa.list_(pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("times", pa.int64())]))


def _segment(rows: list[tuple], nth: int, sources: tuple[int, ...]) -> dict:
    initials = [r[0][:1] for r in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(r[2] - 1 for r in rows)
    return {"nth": nth, "first": initials[0], "last": initials[-1], "illegal": illegal, "edges": _matrix(rows, sources), "rows": [{"role": r[0], "text": r[1], "times": r[2]} for r in rows]}


class _Rows:
    """Rows of a partition's batches, one by one, and the type of its conversations' ids."""

    def __init__(self, batches: Iterator[pa.RecordBatch], *names: str):
        self.batches, self.names, self.id_type = batches, ("conv_id", *names), pa.null()

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.batches:
            self.id_type = batch.schema.field("conv_id").type
            yield from zip(*(batch.column(n).to_pylist() for n in self.names))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows, in order, as segments; numbers of segments rise along the partitions."""
    nth = TaskContext.get().partitionId() << 32
    ids, out, held = [], [], 0
    each = _Rows(batches, "role", "text", "times", "drop", "truncated")

    def batch() -> pa.RecordBatch:
        columns = {"conv_id": pa.array(ids, each.id_type)} | {k: pa.array((s[k] for s in out), t) for k, t in (("nth", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("edges", _EDGES), ("rows", _ROWS))}
        return pa.RecordBatch.from_pydict(columns)

    def pieces() -> Iterator[tuple]:
        """(conversation, rows, whether it goes on from before)."""
        current, rows, size, inside = None, [], 0, True
        for conv, *row in each:
            if rows and (conv != current or len(rows) >= ROWS or size >= BYTES):
                yield current, rows, inside
                inside, rows, size = conv == current, [], 0
            current, size = conv, size + len(row[1])
            rows.append(tuple(row))
        if rows:
            yield current, rows, inside

    for conv, rows, inside in pieces():
        ids.append(conv)
        # The first conversation of a partition may have begun in the one before.
        out.append(_segment(rows, nth, (_START, _SYSTEM, _USER, _ASSISTANT) if inside else (_START,)))
        nth, held = nth + 1, held + sum(len(r[1]) for r in rows)
        if len(out) >= 1000 or held >= BYTES:
            yield batch()
            ids, out, held = [], [], 0
    if out:
        yield batch()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each conversation's matrices, in order: of each segment the state before it and its edits; costs and the whole audit with the first."""
    each = _Rows(batches, "nth", "first", "last", "illegal", "edges")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, nth, state, edits, cost, illegal, audit = zip(*rows)
        return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, each.id_type), "nth": pa.array(nth, pa.int64()), "state": pa.array(state, pa.int32()), "edits": pa.array(edits, pa.string()), "cost": pa.array(cost, pa.int64()), "illegal": pa.array(illegal, pa.int64()), "audit": pa.array(audit, pa.string())})

    rows: list[tuple] = []
    for conv, parts in groupby(each, key=lambda r: r[0]):
        layer, ways, illegal, before = {_START: (0, "")}, [], 0, None
        for _, nth, first, last, inner, edges in parts:
            reached: Layer = {}
            came: dict[int, tuple[int, str]] = {}
            for e in edges:
                if e["source"] in layer:
                    cost, audit = layer[e["source"]]
                    to = (cost + e["cost"], audit + e["audit"])
                    if e["target"] not in reached or to < reached[e["target"]]:
                        reached[e["target"]], came[e["target"]] = to, (e["source"], e["audit"])
            ways.append((nth, came))
            illegal += inner + (before is not None and before + first not in _LEGAL)
            layer, before = reached, last
        state = min((s for s in _FINAL if s in layer), key=lambda s: layer[s])
        cost, audit = layer[state]
        back = []
        for nth, came in reversed(ways):
            state, edits = came[state]
            back.append((conv, nth, state, edits, None, None, None))
        conv, nth, state, edits, *_ = back.pop()
        rows += [*back, (conv, nth, state, edits, cost, illegal, audit)]
        if len(rows) >= 1000:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


@F.arrow_udf(T.StringType())
def _repaired(rows: pa.Array, states: pa.Array, edits: pa.Array) -> pa.Array:
    return pa.array(("\n".join(repaired([(r["role"], r["text"], r["times"]) for r in rs.as_py()], s.as_py(), e.as_py())) for rs, s, e in zip(rows, states, edits)), pa.string())


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's pieces, in order, newline-joined; one piece is in memory at a time."""
    each, ids, digests = _Rows(batches, "piece"), [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, each.id_type), "repaired_sha256": pa.array(digests, pa.string())})

    for conv, pieces in groupby(each, key=lambda r: r[0]):
        digest, joint = hashlib.sha256(), b""
        for _, piece in pieces:
            if piece:
                digest.update(joint + piece.encode())
                joint = b"\n"
        ids.append(conv)
        digests.append(digest.hexdigest())
        if len(ids) >= 1000:
            yield batch()
            ids, digests = [], []
    if ids:
        yield batch()


class Repair:
    """Of ``rows`` (conv_id, turn, role, text, times; see ``damaged``): ``pieces`` (conv_id, nth, piece), the repaired text in order, and ``summary``."""

    def __init__(self, rows: DataFrame):
        self.rows = stored(marked(rows))
        conv = f"conv_id {self.rows.schema['conv_id'].dataType.simpleString()}"
        self.conv = conv
        # Digests as the last key: ranges are drawn from samples of keys, which should not hold texts.
        ordered = self.rows.repartitionByRange("conv_id", "turn", "said").sortWithinPartitions("conv_id", "turn", "said")
        self.segments = stored(ordered.select("conv_id", "role", "text", "times", (F.col("blank") | F.col("seen")).alias("drop"), "truncated").mapInArrow(_cut, f"{conv}, {_SEGMENT}"))
        matrices = self.segments.select("conv_id", "nth", "first", "last", "illegal", "edges").repartition("conv_id").sortWithinPartitions("conv_id", "nth")
        self.chosen = stored(matrices.mapInArrow(_folded, f"{conv}, nth long, state int, edits string, cost long, illegal long, audit string"))
        met = self.segments.select("nth", "rows").join(self.chosen.select("conv_id", "nth", "state", "edits"), "nth")
        self.pieces = met.select("conv_id", "nth", _repaired("rows", "state", "edits").alias("piece"))

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations that have rows."""
        zero = F.lit(0).cast("long")
        clean = ~F.col("blank") & ~F.col("seen")
        counts = {
            "blank": F.when(F.col("blank"), F.col("times")).otherwise(zero),
            "duplicate": F.when(~F.col("blank"), F.col("times") - F.when(F.col("seen"), 0).otherwise(1)).otherwise(zero),
            "truncated": (clean & F.col("truncated")).cast("long"),
        }
        turns = self.rows.withColumns({f"n_{k}": v for k, v in counts.items()}).groupBy("conv_id", "turn").agg(*(F.sum(f"n_{k}").alias(k) for k in counts))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero)
        faults = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(k).alias(k) for k in counts))
        costs = self.chosen.where("cost is not null").select("conv_id", "illegal", "cost", "audit")
        pieces = self.pieces.repartition("conv_id").sortWithinPartitions("conv_id", "nth").select("conv_id", "piece")
        digests = pieces.mapInArrow(_digested, f"{self.conv}, repaired_sha256 string")
        names = [*faults.columns[1:], *costs.columns[1:], "repaired_sha256"]
        together = faults.unionByName(costs, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
        return together.groupBy("conv_id").agg(*(F.max(n).alias(n) for n in names))

    def discard(self) -> None:
        for table in (self.rows, self.segments, self.chosen):
            discard(table)


def summaries(rows: DataFrame) -> DataFrame:
    """What repairing ``rows`` after ``damaged`` finds, one row for each conversation of ``rows``, those that lost all rows included."""
    known = Repair(damaged(rows)).summary()
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    every = known.unionByName(rows.select("conv_id").distinct(), allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(n).alias(n) for n in empty))
    return every.select("conv_id", *(F.coalesce(n, F.lit(v)).alias(n) for n, v in empty.items()))
