"""Findings: rules over calls and lines, suppression, deduplication, summaries, gates, and their sinks.

A finding is (rule, category, severity, cwe, file, line, message). Rules are a
small fixed dimension; findings only ever join it, so it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Severities in order.
SEVERITIES = ("info", "low", "medium", "high", "critical")

#: (rule, category, severity, cwe, called name, receiver pattern, message).
CALL_RULES = (
    ("PY-EVAL", "code_injection", 4, 95, "eval", "", "evaluates text as code"),
    ("PY-EXEC", "code_injection", 4, 95, "exec", "", "executes text as code"),
    ("PY-SYSTEM", "command_injection", 4, 78, "system", "^os$", "runs a shell command"),
    ("PY-POPEN", "command_injection", 3, 78, "popen", "^os$", "runs a shell command"),
    ("PY-PICKLE", "deserialization", 4, 502, "loads", "^c?[pP]ickle$", "loads pickled data"),
    ("PY-MARSHAL", "deserialization", 3, 502, "loads", "^marshal$", "loads marshalled data"),
    ("PY-YAML", "deserialization", 3, 502, "load", "^yaml$", "loads YAML without a safe loader"),
    ("PY-MD5", "weak_crypto", 2, 327, "md5", "^hashlib$", "uses a weak hash"),
    ("PY-SHA1", "weak_crypto", 2, 327, "sha1", "^hashlib$", "uses a weak hash"),
    ("PY-TMP", "path_traversal", 2, 22, "mktemp", "^tempfile$", "uses a predictable name"),
    ("PY-FETCH", "ssrf", 2, 918, "urlopen", "", "fetches an address"),
)
#: (rule, category, severity, cwe, pattern, message).
LINE_RULES = (
    ("TXT-SECRET", "secrets", 4, 798, r"(?i)(api_?key|secret|token|password)\s*[=:]\s*['\"][A-Za-z0-9+/_-]{8,}['\"]", "holds a secret"),
    ("TXT-AWS", "secrets", 4, 798, r"AKIA[0-9A-Z]{16}", "holds an access key"),
    ("TXT-SQL", "sql_injection", 3, 89, r"(?i)(execute|query)\(\s*(f['\"]|['\"][^'\"]*['\"]\s*[%+])", "builds SQL from text"),
    ("TXT-REDOS", "redos", 2, 1333, r"\([^()]*[+*]\)[+*]", "nests quantifiers"),
)


def _table(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))))


def call_findings(calls: DataFrame, rules=CALL_RULES) -> DataFrame:
    """Findings of (file, target, receiver, line): an equi-join on the called name, then the receiver's pattern."""
    table = _table(calls.sparkSession, ("rule", "category", "severity", "cwe", "target", "pattern", "message"), rules)
    met = calls.join(table, "target").where(F.rlike(F.coalesce("receiver", F.lit("")), F.col("pattern")))
    return met.select("rule", "category", "severity", "cwe", "file", "line", "message")


def line_findings(files: DataFrame, rules=LINE_RULES) -> DataFrame:
    """Findings in (path, text), line by line, in one pass over each file."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    names = ("rule", "category", "severity", "cwe", "message")
    hits = F.array(*(F.when(F.rlike("text", F.lit(r[4])), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (*r[:4], r[5]))))) for r in rules))
    return lines.select("file", (F.col("n") + 1).alias("line"), F.inline(F.filter(hits, lambda h: h.isNotNull()))).select("rule", "category", "severity", "cwe", "file", "line", "message")


def markers(files: DataFrame) -> DataFrame:
    """(file, line, rules): suppression comments; no rules named: all."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    marker = r"(?:#|//)\s*(?:nosec|noqa|security-ignore|nolint|suppress)\b:?[ ]*([A-Z0-9, -]*)"
    named = F.filter(F.split(F.regexp_extract("text", marker, 1), "[, ]+"), lambda r: r != "")
    return lines.where(F.rlike("text", F.lit(marker))).select("file", (F.col("n") + 1).alias("line"), named.alias("rules"))


def suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """``findings`` with ``suppressed``: a marker for the rule stands on the line or on the one before."""
    spread = marks.select("file", F.explode(F.array("line", F.col("line") + 1)).alias("line"), F.explode_outer("rules").alias("only"))
    grouped = spread.groupBy("file", "line").agg(F.bool_or(F.col("only").isNull()).alias("every"), F.collect_set("only").alias("named"))
    joined = findings.join(grouped, ["file", "line"], "left")
    return joined.withColumn("suppressed", F.coalesce(F.col("every") | F.array_contains("named", F.col("rule")), F.lit(False))).drop("every", "named")


def deduplicated(findings: DataFrame, *key: str) -> DataFrame:
    """The most severe finding of each key (file, line, category by default), then the first rule by name."""
    w = Window.partitionBy(*(key or ("file", "line", "category"))).orderBy(F.col("severity").desc(), "rule")
    return findings.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by category, by severity and in all, in one pass."""
    grouped = findings.groupingSets([["category"], ["severity"], []], "category", "severity")
    return grouped.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def gate(findings: DataFrame, most: dict[int, int]) -> DataFrame:
    """(passed, reasons): no severity has more findings than ``most`` allows it."""
    counts = findings.agg(*(F.count_if(F.col("severity") == s).alias(f"s{s}") for s in most))
    reasons = F.filter(F.array(*(F.when(F.col(f"s{s}") > n, F.concat(F.col(f"s{s}").cast("string"), F.lit(f" {SEVERITIES[s]}"))) for s, n in most.items())), lambda r: r.isNotNull())
    return counts.select((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON text a finding, in the form of a SARIF result; write with ``.write.text``."""
    level = F.when(F.col("severity") >= 3, "error").when(F.col("severity") == 2, "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def mermaid(edges: DataFrame, graph_of: str) -> DataFrame:
    """(graph_of, value): a flow chart for each graph of (graph_of, src, dst, label)."""
    line = F.concat(F.lit("    "), F.col("src").cast("string"), F.when(F.col("label").isNotNull(), F.concat(F.lit(" -->|"), "label", F.lit("| "))).otherwise(" --> "), F.col("dst").cast("string"))
    return edges.groupBy(graph_of).agg(F.concat_ws("\n", F.lit("flowchart TD"), F.array_sort(F.collect_list(line))).alias("value"))


def dot(edges: DataFrame, graph_of: str) -> DataFrame:
    """(graph_of, value): a DOT text for each graph of (graph_of, src, dst)."""
    line = F.concat(F.lit('    "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";'))
    return edges.groupBy(graph_of).agg(F.concat_ws("\n", F.lit("digraph {"), F.concat_ws("\n", F.array_sort(F.collect_list(line))), F.lit("}")).alias("value"))
