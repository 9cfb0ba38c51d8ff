"""What a reader, or a model, needs to see of a program to follow one entry point: the entry and what it calls, within a budget of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import graph


def sources(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(node, title, code, lines) of ``functions`` (file, qualified, start_line, end_line) in ``files`` (path, text)."""
    size = F.col("end_line") - F.col("start_line") + 1
    title = F.concat("qualified", F.lit(" ("), "file", F.lit(":"), "start_line", F.lit("-"), "end_line", F.lit(")"))
    met = functions.join(files.withColumnRenamed("path", "file"), "file")
    code = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), size), "\n")
    return met.select(F.concat_ws("::", "file", "qualified").alias("node"), title.alias("title"), code.alias("code"), size.cast("long").alias("lines"))


def contexts(edges: DataFrame, entries: DataFrame, known: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(entry, functions, n, lines, text): each of ``entries`` (node) with what it calls in at most ``depth`` steps, nearest first, by name among equals.

    ``known`` is what ``sources`` gives. Functions are taken while the sum of
    their lines stays within ``budget``; the entry itself always is. The sum
    runs over what one entry reaches; texts join only for what is taken.
    """
    found = graph.reach_from(edges.select("src", "dst"), entries.select("node").distinct(), depth)
    sized = found.join(known.select("node", "lines"), "node")
    nearest = Window.partitionBy("origin").orderBy("distance", "node").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.lit(True) if budget is None else (F.col("total") <= budget) | (F.col("distance") == 0)
    taken = sized.withColumn("total", F.sum("lines").over(nearest)).where(fits).select("origin", "node", "distance", "lines")
    parts = taken.join(known.select("node", "title", "code"), "node").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("distance", "node", "lines", "title", "code"))).alias("parts"))
    callees = F.filter("parts", lambda p: p["distance"] > 0)
    text = F.concat(
        F.array_join(F.transform(F.filter("parts", lambda p: p["distance"] == 0), lambda p: F.concat(F.lit("# Entry: "), p["title"], F.lit("\n"), p["code"])), "\n"),
        F.when(F.size(callees) > 0, F.lit("\n\n## Callees:")).otherwise(""),
        F.array_join(F.transform(callees, lambda p: F.concat(F.lit("\n\n### "), p["title"], F.lit("\n"), p["code"])), ""),
    )
    lines = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["lines"])
    return parts.select(F.col("origin").alias("entry"), F.transform(callees, lambda p: p["node"]).alias("functions"), F.size(callees).cast("long").alias("n"), lines.alias("lines"), text.alias("text"))
