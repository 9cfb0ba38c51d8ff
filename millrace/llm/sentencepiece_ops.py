"""SentencePiece encoding with source byte spans, and decoding, as Spark operators.

The normaliser takes the longest prefix that the model's compiled character
map knows and records where in the source each output byte came from; pieces
are found on the normalised text and projected back through that record.
Segments between spaces that are new are merged together, a slice of texts at a
time, and remembered up to a bound.

Null text is encoded like the empty one: no ids. Rows are kept one to one,
repeated rows and null ids included; existing columns of the outputs' names
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.piece_model import PieceModel

_loaded: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


#: Bytes of text, as Arrow holds them, whose pieces are made and handed on at once.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, column: int):
    """Runs of rows with about ``SLICE`` bytes in ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(a, b - a)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32, copy=False)))


def with_pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Columns ``keep`` (all) of ``df``, and arrays ``ids``, ``begins`` and ``ends`` (source bytes, end exclusive).

    ``decoded`` names a further column for the text that the ids decode to.
    """
    made = ["ids", "begins", "ends", *([decoded] if decoded else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in [m.lower() for m in made]]
    source = df.select(F.col(text).alias("_source"), *[f"`{c}`" for c in kept])
    schema = T.StructType([*source.schema.fields[1:], *(T.StructField(c, T.StringType() if c == decoded else T.ArrayType(T.IntegerType())) for c in made)])

    def run(batches):
        model = _model(path)
        for batch in batches:
            for part in slices(batch, 0):
                ids, begins, ends = map(list, zip(*model.encode_all([t.as_py() or "" for t in part.column(0)])))
                out = [_lists(ids), _lists(begins), _lists(ends)]
                if decoded:
                    out.append(pa.array(map(model.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *out], [*kept, *made])

    return source.mapInArrow(run, schema)


def with_decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of the piece ids in ``ids``; null ids give null."""

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        one = _model(path).decode
        return pa.array((None if not x.is_valid else one(x.as_py()) for x in lists), pa.string())

    return df.withColumn(out, decode(F.col(ids)))
