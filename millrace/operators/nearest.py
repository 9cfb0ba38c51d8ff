"""Exact nearest neighbours of a query set, and all pairs above a likeness, in blocks.

Items and queries are packed into blocks of vectors; each pair of blocks is one
matrix product in a task, which hands on at most k rows for each query. Block
pairs come from an equi-join on the query block's number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.lineage import stored

ITEMS, QUERIES = 2048, 256


def _packed(vectors: DataFrame, rows: int, n_rows: int, name: str) -> DataFrame:
    blocks = max(1, -(-n_rows // rows))
    return vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias(f"{name}_block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_values"))


def cosine_top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, rank): for each query the k items of other id most like it, ties by id; similarities to six places."""
    n_items, n_queries = items.count(), queries.count()
    left, right = _packed(items, ITEMS, n_items, "item"), _packed(queries, QUERIES, n_queries, "query")
    numbers = F.sequence(F.lit(0), F.lit(max(1, -(-n_queries // QUERIES)) - 1)).cast("array<long>")
    pairs = left.withColumn("query_block", F.explode(numbers)).join(right, "query_block")

    def best(batches):
        for batch in batches:
            for row in batch.itertuples():
                a = np.asarray(row.query_values, float).reshape(len(row.query_ids), -1)
                b = np.asarray(row.item_values, float).reshape(len(row.item_ids), -1)
                size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
                s = np.round(np.where(size < 1e-12, 0, a @ b.T / np.where(size < 1e-12, 1, size)), 6)
                ids = np.asarray(row.item_ids)
                for q, values in zip(row.query_ids, s):
                    order = np.lexsort((ids, -values))
                    order = order[ids[order] != q][:k]
                    yield pd.DataFrame({"query": q, "id": ids[order], "similarity": values[order]})

    found = pairs.select("query_ids", "query_values", "item_ids", "item_values").mapInPandas(best, "query long, id long, similarity double")
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Vectors whose cells the others are dealt to, at most; they and their cells' radii are all that the driver holds.
PIVOTS = 256
#: Added to every bound, far above the error of an angle in double precision.
CARE = 1e-6


def _unit(rows) -> np.ndarray:
    a = np.asarray(rows.to_pylist(), float).reshape(len(rows), -1)
    return a / np.linalg.norm(a, axis=1)[:, None]


class SimilarPairs:
    """All pairs of ``vectors`` (id, vector) with a cosine of ``threshold`` or more, none lost.

    Equal vectors are one class before anything is compared; ``members`` (id,
    representative) tells who is in it, ``pairs`` (a, b, similarity), a < b,
    links representatives. Zero vectors and nulls are like nothing.

    Vectors are dealt to the nearest of a sample of pivots. Angles are a
    metric, so a vector need meet a cell only if its angle to the cell's pivot
    is within the cell's radius and the threshold's angle, and of two cells
    only the one with the higher number is visited. Cells are cut to blocks of
    ``ITEMS`` vectors, so a cell of any size is many tasks.
    """

    def __init__(self, vectors: DataFrame, threshold: float, pivots: int = PIVOTS):
        some = vectors.where("vector is not null and exists(vector, x -> x <> 0)")
        self.vectors, self.classes = some, stored(some.groupBy("vector").agg(F.min("id").alias("representative")))
        self.limit = float(np.arccos(min(1.0, threshold)))
        self.threshold = threshold
        reps = self.classes.select(F.col("representative").alias("id"), "vector")
        chosen = [r["vector"] for r in reps.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
        centres = np.asarray(chosen, float)
        self.centres = centres / np.linalg.norm(centres, axis=1)[:, None] if chosen else centres
        self.homes = stored(reps.withColumn("home", self._home()(F.col("vector"))).select("id", "vector", "home.*"))
        rows = self.homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
        self.radii = {r["cell"]: r["radius"] for r in rows}
        self.chunks = {r["cell"]: -(-r["n"] // ITEMS) for r in rows}

    def _home(self):
        centres = self.centres

        @F.arrow_udf("struct<cell: int, angle: double>")
        def home(vectors: pa.Array) -> pa.Array:
            cosines = _unit(vectors) @ centres.T
            cell = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            return pa.StructArray.from_arrays([pa.array(cell.astype("int32")), pa.array(angle)], ["cell", "angle"])

        return home

    def _visits(self):
        cells = np.array(sorted(self.radii))
        centres, reach = self.centres[cells], np.array([self.radii[c] for c in cells]) + self.limit + CARE

        @F.arrow_udf("array<int>")
        def visits(vectors: pa.Array, own: pa.Array) -> pa.Array:
            near = np.arccos(np.clip(_unit(vectors) @ centres.T, -1, 1)) <= reach
            near &= cells >= np.asarray(own)[:, None]
            return pa.array(([int(c) for c in cells[row]] for row in near), pa.list_(pa.int32()))

        return visits

    def block_pairs(self) -> DataFrame:
        """(cell, chunk, ids, vectors, other_cell, ...): blocks that meet; of all pairs of blocks, those that the bounds leave."""
        homes, in_cell = self.homes, F.create_map(*(F.lit(x) for c, n in self.chunks.items() for x in (c, n)))
        chunk = F.pmod(F.xxhash64("id"), F.element_at(in_cell, F.col("cell"))).cast("int")
        placed = homes.withColumn("chunk", chunk)
        packed = lambda df, *keys: df.groupBy(*keys).agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vectors"))
        held = packed(placed, "cell", "chunk")
        going = placed.withColumn("to", F.explode(self._visits()(F.col("vector"), F.col("cell"))))
        probes = packed(going, "to", "cell", "chunk").select(F.col("to").alias("cell"), F.col("cell").alias("from_cell"), F.col("chunk").alias("from_chunk"), F.col("ids").alias("probe_ids"), F.col("vectors").alias("probe_vectors"))
        everywhere = probes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(in_cell, F.col("cell")).cast("int") - 1)))
        return everywhere.join(held, ["cell", "chunk"])

    def pairs(self) -> DataFrame:
        """(a, b, similarity), a < b, of representatives; similarities to six places."""
        threshold, kind = self.threshold, self.homes.schema["id"].dataType.simpleString()
        if not self.chunks:
            return self.homes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("angle").alias("similarity"))

        def like(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    a, b = _unit(pa.array(row["probe_vectors"])), _unit(pa.array(row["vectors"]))
                    s = a @ b.T
                    i, j = np.nonzero(s >= threshold)
                    left, right = np.asarray(row["probe_ids"])[i], np.asarray(row["ids"])[j]
                    # In one cell both of a pair visit, the lower id counts; across cells one does.
                    keep = (left < right) if row["from_cell"] == row["cell"] else np.ones(len(i), bool)
                    left, right, s = left[keep], right[keep], np.round(s[i, j][keep], 6)
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.where(left < right, left, right)), "b": pa.array(np.where(left < right, right, left)), "similarity": pa.array(s)})

        return self.block_pairs().select("cell", "from_cell", "ids", "vectors", "probe_ids", "probe_vectors").mapInArrow(like, f"a {kind}, b {kind}, similarity double")

    def members(self) -> DataFrame:
        """(id, representative) of all vectors that can be like others."""
        return self.vectors.join(self.classes, "vector").select("id", "representative")
