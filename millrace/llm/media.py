"""Media columns: baseline JPEG files in binary columns, written, read back and described.

``with_payload_image`` stores bytes losslessly as quantised coefficients, one
8 by 8 block for 64 bytes. ``with_media`` reads any baseline file: markers are
parsed, scans Huffman-decoded, and the DC coefficients alone give a luminance
thumbnail; dimensions and the thumbnail's hash are stored.

Defined cases: a null payload is the empty one, stored as 64 zeros; a null file
gives null; a file that is not baseline JPEG gives null fields and the reason
in ``error``; equal payloads give equal files; other columns and repeated rows
stay, existing columns of the outputs' names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import jpeg

#: Bytes of files that are decoded in step.
SLICE = 3 << 20


def padded(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % jpeg.BLOCK if raw else jpeg.BLOCK)


@F.arrow_udf(T.BinaryType())
def _image(payloads: pa.Array) -> pa.Array:
    return pa.array((jpeg.encode(padded(p.as_py() or b"")) for p in payloads), pa.binary())


_FIELDS = (("width", T.IntegerType(), pa.int32()), ("height", T.IntegerType(), pa.int32()), ("payload", T.BinaryType(), pa.binary()), ("thumbnail", T.BinaryType(), pa.binary()), ("thumbnail_hash", T.StringType(), pa.string()), ("error", T.StringType(), pa.string()))
_MEDIA = T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS])
_ARROW = pa.struct([(n, a) for n, _, a in _FIELDS])


def _described(image: jpeg.Image) -> dict:
    thumb = image.thumbnail
    return {
        "width": image.width,
        "height": image.height,
        "payload": image.payload if image.comment.startswith(b"payload=") else None,
        "thumbnail": thumb.tobytes(),
        "thumbnail_hash": f"{jpeg.difference_hash(thumb):016x}",
        "error": None,
    }


def _decoded(files: list[bytes]) -> list[dict]:
    try:
        return list(map(_described, jpeg.decode(files)))
    except (ValueError, IndexError, KeyError, StopIteration) as fault:
        if len(files) > 1:  # find the file at fault
            return [d for f in files for d in _decoded([f])]
        return [dict.fromkeys(_ARROW.names) | {"error": str(fault) or type(fault).__name__}]


@F.arrow_udf(_MEDIA)
def _media(files: pa.Array) -> pa.Array:
    out: list[dict | None] = []
    held: list[bytes] = []
    size = 0
    for f in files:
        if not f.is_valid:
            out += _decoded(held) if held else []
            held, size = [], 0
            out.append(None)
            continue
        held.append(f.as_py())
        size += len(held[-1])
        if size >= SLICE:
            out += _decoded(held)
            held, size = [], 0
    out += _decoded(held) if held else []
    return pa.array(out, _ARROW)


def with_payload_image(df: DataFrame, payload: str, out: str = "image") -> DataFrame:
    """``df`` with a JPEG file that holds ``payload`` (string as UTF-8, or binary), zeros appended up to a multiple of 64."""
    return df.withColumn(out, _image(F.col(payload).cast("binary")))


def with_media(df: DataFrame, image: str = "image", out: str = "media") -> DataFrame:
    """``df`` with struct<width, height, payload, thumbnail, thumbnail_hash, error> of a column of JPEG files."""
    return df.withColumn(out, _media(F.col(image)))
