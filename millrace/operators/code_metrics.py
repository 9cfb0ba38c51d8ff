"""Reports over the relations of source code: functions, files, classes, documentation, tests, coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import measures

#: Fixed values: (issue, column, most).
THRESHOLDS = (("long", "length", 50), ("complex", "cyclomatic", 10), ("hard_to_read", "cognitive", 15), ("deep", "nesting", 4), ("many_parameters", "n_params", 5), ("many_returns", "returns", 4))


def function_report(functions: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``functions`` with length, number of parameters, risk band and the names of exceeded thresholds."""
    bare = F.filter("params", lambda p: ~p.isin("self", "cls"))
    sized = functions.withColumns({"length": F.col("end_line") - F.col("start_line") + 1, "n_params": F.size(bare)})
    issues = F.filter(F.array(*(F.when(F.col(c) > most, name) for name, c, most in thresholds)), lambda x: x.isNotNull())
    return sized.withColumns({"risk": measures.risk_band(F.col("cyclomatic")), "issues": issues})


def line_counts(files: DataFrame) -> DataFrame:
    """(path, physical, blank, comment, code) of (path, text), for languages with # or // comments."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    blank = F.size(F.filter(lines, lambda x: x == ""))
    comment = F.size(F.filter(lines, lambda x: x.startswith("#") | x.startswith("//")))
    counted = files.select("path", F.size(lines).alias("physical"), blank.alias("blank"), comment.alias("comment"))
    return counted.withColumn("code", F.col("physical") - F.col("blank") - F.col("comment"))


def file_report(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of each file with the number, mean and greatest complexity of its functions."""
    per = function_report(functions).groupBy("file").agg(
        F.count("*").alias("functions"), F.round(F.avg("cyclomatic"), 4).alias("mean_complexity"), F.max("cyclomatic").alias("most_complex"), F.sum(F.size("issues")).alias("issues")
    )
    return line_counts(files).join(per.withColumnRenamed("file", "path"), "path", "left").fillna(0, ["functions", "issues"])


def class_report(functions: DataFrame, many: int = 20) -> DataFrame:
    """Methods, summed complexity and a god-class score of each class: excess methods and complexity over thresholds."""
    classes = functions.where("owner is not null").groupBy("file", "owner").agg(F.count("*").alias("methods"), F.sum("cyclomatic").alias("complexity"))
    score = F.greatest(F.lit(0), F.col("methods") - many) * 2 + F.greatest(F.lit(0), F.col("complexity") - 5 * many) / 5
    return classes.withColumn("score", score.cast("double")).withColumn("god", F.col("score") >= 10)


def documentation(functions: DataFrame) -> DataFrame:
    """(file, kind, documented, total): coverage by docstrings, methods apart from functions."""
    kind = F.when(F.col("owner").isNull(), "function").otherwise("method")
    return functions.groupBy("file", kind.alias("kind")).agg(F.count_if(F.length(F.trim("docstring")) > 0).alias("documented"), F.count("*").alias("total"))


def weak_tests(functions: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Test functions with the number of their assertions and mocks, and whether they check nothing."""
    tests = functions.where(F.col("name").startswith("test")).select("file", F.col("qualified").alias("caller"), "start_line", "end_line")
    called = calls.groupBy("file", "caller").agg(F.count_if(F.rlike("target", F.lit("^assert"))).alias("called"), F.count_if(F.rlike("target", F.lit("(?i)mock|patch"))).alias("mocks"))
    text = tests.join(files.withColumnRenamed("path", "file"), "file").withColumn("body", F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1))
    stated = text.select("file", "caller", F.size(F.filter("body", lambda x: F.rlike(x, F.lit(r"^\s*(assert\b|with pytest\.raises)")))).alias("stated"))
    both = stated.join(called, ["file", "caller"], "left")
    return both.select("file", F.col("caller").alias("test"), (F.col("stated") + F.coalesce("called", F.lit(0))).alias("assertions"), F.coalesce("mocks", F.lit(0)).alias("mocks")).withColumn("weak", F.col("assertions") == 0)


def file_coupling(edges: DataFrame) -> DataFrame:
    """Afferent and efferent coupling of files, from call edges between nodes file::name."""
    of = lambda c: F.substring_index(c, "::", 1)
    return measures.coupling(edges.select(of("src").alias("module"), of("dst").alias("uses")).where("module != uses"))
