"""Fill-in-the-middle: a text is cut at two random units and its middle is put last.

The matcher reads a text twice and keeps two numbers: the first pass counts
units, the second advances a lazy match iterator to the lower and the higher
rank and stops there. No list of units exists at any time, so memory does not
depend on how many there are. A unit is a word with the blanks before it; the
blanks at the end of a text are one. Python gives only the places of the cuts;
Spark cuts and joins the texts.

Whether a text is transformed, into which form and at which ranks follows from
a hash of ``seed`` and its id alone, so that a lost task does the same again.
Texts that hold a marker already stay as they are, since nobody could take
them apart afterwards.

Defined cases: a null text is the empty one, which stays plain; a null id
hashes as an empty string; rows with one id and one text get one output, rows
with one id and several texts the same random numbers; texts of one unit have
empty parts; texts are read whole at any length; an empty table gives an empty
result; a column of the output's name is replaced, all others are kept.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ANY_MARKER = "<[PSM]>"

_FIELDS = (("n", T.LongType(), pa.int64()), ("prefix", T.LongType(), pa.int64()), ("middle", T.LongType(), pa.int64()))


def cuts(text: str, h1: int | None, h2: int | None) -> tuple[int, int | None, int | None]:
    """Units of ``text``, and code points before and between the cuts, which lie after ``h1`` and ``h2`` units modulo one more than all; no cuts for nulls."""
    n = sum(1 for _ in UNIT.finditer(text))
    if h1 is None or h2 is None:
        return n, None, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix = end = 0
    if high:
        for rank, unit in enumerate(UNIT.finditer(text), 1):
            end = unit.end()
            if rank == low:
                prefix = end
            if rank == high:
                break
    return n, prefix, end - prefix


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS]))
def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = [cuts(t.as_py() or "", a.as_py(), b.as_py()) for t, a, b in zip(texts, h1, h2)]
    return pa.StructArray.from_arrays([pa.array((f[k] for f in found), kind) for k, (_, _, kind) in enumerate(_FIELDS)], [n for n, _, _ in _FIELDS])


def with_fim(docs: DataFrame, text: str = "text", id: str = "doc_id", out: str = "fim", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with ``out``: struct<n, form, prefix_chars, middle_chars, output>.

    ``rate`` of 100 texts are transformed, of these ``spm`` of 100 suffix
    first (``spm``), the others prefix first (``psm``).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4))
    plain = (whole == "") | F.rlike(whole, F.lit(_ANY_MARKER)) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    found = _cuts(whole, F.when(~plain, h1), F.when(~plain, h2))
    first, second = found["prefix"].cast("int"), found["middle"].cast("int")
    prefix, middle = F.substr(whole, F.lit(1), first), F.substr(whole, first + 1, second)
    suffix = F.substr(whole, first + second + 1, F.char_length(whole))
    output = F.when(form == "plain", whole).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    return docs.withColumn(out, F.struct(found["n"].alias("n"), form.alias("form"), found["prefix"].alias("prefix_chars"), found["middle"].alias("middle_chars"), output.alias("output")))


def restored(fim: Column) -> Column:
    """The text again, from ``output`` and ``form``: a transformed text holds each marker once, and no marker can arise across a joint."""
    part = F.split(fim["output"], _ANY_MARKER, -1)
    return F.when(fim["form"] == "plain", fim["output"]).when(fim["form"] == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))
