"""URL filters, in DataFrame functions only: rules fetched by their rarest literal token.

A rule is a host and a path prefix (it fits the host, all its subdomains, and
every path that starts so), or a bare pattern on host and path. Both become a
regular expression over "host path-with-slash". A rule's literal tokens are the
runs of letters and digits that its pattern delimits on both sides; the rarest
of them, by a count over all URLs, is the rule's only entry in the index. The
tokens of a URL fetch candidate rules by a join, and only those run their
expression. Host rules come before bare patterns, longer ones before shorter.

A rule without a literal stands under the empty token, which every URL has.

Distinct URLs are judged once. The index has one row a rule; it is joined, not
forced to be broadcast, so its size has no bound to keep. What was found for
URLs grows with them and is joined by sorting.

Defined cases: a null URL, or one without "://", has an empty host and path and
is allowed unless a rule says otherwise; very long URLs are read whole; repeated
rows and null ids stay; an empty table gives an empty result; existing columns
of the outputs' names are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.lineage import stored
from millrace.names import free

#: (verdict, host, path prefix).
HOST_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: (verdict, word): blocks a URL with that word between other than letters and digits.
WORD_RULES = tuple(("block", w) for w in ("adult", "betting", "casino", "escort", "malware", "phishing", "pills", "poker", "porn", "spam", "torrent", "viagra", "warez", "xxx"))
DEFAULT = "allow"

_RULE = "rule string, verdict string, grade int, length int, pattern string, tokens array<string>"


def _rules(host_rules, word_rules):
    for verdict, host, path in host_rules:
        literals = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=/)[a-z0-9]+(?=[^A-Za-z0-9])", path)
        yield host + path, verdict, 1, len(host + path), rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", literals
    for verdict, word in word_rules:
        yield word, verdict, 0, len(word), rf"(?i)(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)", [word]


def _literal(value) -> Column:
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def rule_table(spark: SparkSession, host_rules=HOST_RULES, word_rules=WORD_RULES) -> DataFrame:
    names = [f.split(" ")[0] for f in _RULE.split(", ")]
    rows = F.array(*(F.struct(*(_literal(v).alias(n) for n, v in zip(names, rule))) for rule in _rules(host_rules, word_rules)))
    return spark.range(1).select(F.inline(rows))


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(text: str) -> Column:
    """Tokens of ``text``, the empty one always among them."""
    return F.array_distinct(F.array_append(F.split(F.lower(text), "[^a-z0-9]+"), F.lit("")))


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``: of their literals the one in the fewest of ``urls``, the longest and first of equals."""
    literals = rules.select("rule", "grade", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = urls.select(F.explode(_tokens("target")).alias("token")).join(literals.select("token").distinct(), "token").groupBy("token").count()
    best = Window.partitionBy("rule", "grade").orderBy(F.coalesce("count", F.lit(0)), F.length("token").desc(), "token")
    chosen = literals.join(seen, "token", "left").withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return rules.drop("tokens").join(chosen.select("rule", "grade", "token"), ["rule", "grade"])


def judged(pages: DataFrame, url: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the host rule that decides, else null), ``pattern_rule`` and ``verdict``."""
    made = ("host", "path", "rule", "pattern_rule", "verdict")
    rules = rule_table(pages.sparkSession) if rules is None else rules
    parts = pages.drop(*made).withColumns({"host": host_of(url), "path": path_of(url)})
    whole, target, best = free(parts, "whole", "target", "best")
    parts = parts.withColumn(whole, F.concat("host", "path"))
    urls = stored(parts.select(F.col(whole).alias("target")).distinct())
    entries = stored(index(rules, urls))
    candidates = urls.select("target", F.explode(_tokens("target")).alias("token")).join(entries, "token")
    fits = candidates.where(F.rlike("target", F.col("pattern")) & ((F.col("grade") == 0) | F.col("target").contains("/")))
    found = fits.groupBy(F.col("target").alias(target)).agg(F.max(F.struct("grade", "length", "rule", "verdict")).alias(best))
    joined = parts.join(stored(found).hint("merge"), F.col(whole) == F.col(target), "left")
    of_host = F.col(f"{best}.grade") == 1
    return joined.withColumns({
        "rule": F.when(of_host, F.col(f"{best}.rule")),
        "pattern_rule": F.when(~of_host, F.col(f"{best}.rule")),
        "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(DEFAULT)),
    }).drop(whole, target, best)
