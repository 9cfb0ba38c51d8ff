"""Structured Streaming over an events folder: windowed counts by batch, merged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files under ``path``, or the one that it names, as a stream."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 4)
    parent, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, length: str) -> DataFrame:
    """(start, event_type, n, cents) of a table of events by tumbling window; rows without a time have a null start."""
    timed = events.withColumn("start", F.window("ts", length)["start"])
    both = timed.unionByName(events.where("ts is null").withColumn("start", F.col("ts")))
    return both.groupBy("start", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def run_to_end(events: DataFrame, length: str) -> DataFrame:
    """Windowed counts of a stream over all that is there, in whatever order its rows come.

    Each batch is counted alone and the counts are added up: there is no state
    and no watermark, so no row is too late.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        windowed_counts(batch, length).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("start timestamp_ntz, event_type string, n long, cents long, batch long").parquet(f"{base}/rows")
    return rows.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
