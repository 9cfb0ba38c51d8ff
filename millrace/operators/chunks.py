"""Greedy chunks of texts within a token budget, with overlap, cut at the best boundary near the end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How much a line is worth as the first of a new chunk, by what it starts with.
BOUNDARIES = (("class ", 4), ("def ", 4), ("async def ", 4), ("fn ", 4), ("func ", 4), ("#", 2), ("", 3))


def _worth(line: str) -> int:
    bare = line.strip()
    return 3 if not bare else next((w for start, w in BOUNDARIES[:-1] if bare.startswith(start)), 1)


def chunk(text: str, budget: int, overlap: int) -> list[dict]:
    """Line ranges: as many lines as fit a quarter of their characters into ``budget``, cut at the worthiest line of the last third."""
    lines = text.split("\n")
    cost = [len(x) // 4 + 1 for x in lines]
    out, first = [], 0
    while first < len(lines):
        end, spent = first, 0
        while end < len(lines) and (end == first or spent + cost[end] <= budget):
            spent += cost[end]
            end += 1
        if end < len(lines):
            start = first + max(1, (end - first) * 2 // 3)
            end = max(range(start, end + 1), key=lambda i: (_worth(lines[i]), i)) if start <= end else end
        out.append({"first_line": first + 1, "end_line": end, "tokens": sum(cost[first:end])})
        if end >= len(lines):
            break
        back, shared = end, 0
        while back > first + 1 and shared + cost[back - 1] <= overlap:
            back -= 1
            shared += cost[back]
        first = back
    return out


_NAMES = ("first_line", "end_line", "tokens")


def with_chunks(df: DataFrame, text: str = "text", budget: int = 512, overlap: int = 64) -> DataFrame:
    """``df`` without ``text``, a row for each chunk: ``chunk`` (from 0), ``first_line``, ``end_line``, ``tokens``, ``chunk_text``; the empty and the null text have none."""
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in _NAMES]))
    arrow = pa.list_(pa.struct([(n, pa.int32()) for n in _NAMES]))

    @F.arrow_udf(kind)
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array((chunk(t.as_py(), budget, overlap) if t.as_py() else [] for t in texts), arrow)

    rows = df.withColumn("_lines", F.split(text, "\n")).withColumn("_cuts", cut(F.col(text))).drop(text)
    cuts = rows.select("*", F.posexplode("_cuts").alias("chunk", "c")).select("*", "c.*")
    part = F.array_join(F.slice("_lines", F.col("first_line"), F.col("end_line") - F.col("first_line") + 1), "\n")
    return cuts.withColumn("chunk_text", part).drop("_lines", "_cuts", "c")
