"""Tables by name, and the relations over them that the graph queries walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customer to order to supplier to nation to region, each edge once."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
        .unionByName(t("lineitem").select(node("o", "l_orderkey").alias("src"), node("s", "l_suppkey").alias("dst")).distinct())
        .unionByName(t("supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")))
        .unionByName(t("nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")))
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the user's following event type as ``next_type``."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("next_type", F.lead("event_type").over(w))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, line): every line of every document, from 0."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))


def code_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("py",), exclude: str = r"(^|/)(\.git|node_modules|target|__pycache__)/") -> DataFrame:
    """(path, length, modified, language, text) of a source tree, by extension, ignored folders left out."""
    names = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "js": "javascript", "java": "java", "c": "c", "cpp": "cpp"}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    language = F.coalesce(*(F.when(extension == e, n) for e, n in names.items()), F.lit("other"))
    kept = files.where(extension.isin(*extensions)).where(~F.rlike("path", F.lit(exclude)))
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), language.alias("language"), F.decode("content", "UTF-8").alias("text"))
