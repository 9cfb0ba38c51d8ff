"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one in the warehouse, which a cluster shares too.

    Off local mode a folder must be set: the default warehouse lies on each
    machine's own disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if chosen is None and not sc.master.startswith("local") and sc.getConf().get("spark.sql.warehouse.dir") is None:
            raise ValueError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder that all machines share")
        sc.setCheckpointDir(chosen or f"{spark.conf.get('spark.sql.warehouse.dir')}/_millrace")
    return sc.getCheckpointDir()


#: Spark then drops a query's shuffle files when it ends; of use only where nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, batch: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Unlike a persisted block, the files outlive any executor. They go with
    the session's checkpoint folder; ``discard`` drops them earlier. The
    shuffle files of the write go when it ends. ``batch`` bounds the rows of
    an Arrow batch, where rows are wide.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _set(spark, {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """``df`` if it is a ``stored`` table, else ``stored(df)``: for what several rounds read."""
    return df if getattr(df, "_stored_at", None) else stored(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later plan reads."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
