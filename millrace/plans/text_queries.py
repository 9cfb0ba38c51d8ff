"""Queries over texts and pages: lines, tokens, clones, findings, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.lineage import stored
from millrace.operators import clones, measures
from millrace.sources.tables import document_lines, table

QUERIES, SQL = {}, {}

WORD, SIGN = "[A-Za-z0-9_]+", "[^A-Za-z0-9_ \t\r\n]"
_LINES = """lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"""
_NORMAL = r"trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'))"
_LICENSE = "|".join(tx.LICENSE_PHRASES)
#: (rule, severity, pattern) of the findings on texts and on pages; patterns keep to what all engines share.
TEXT_RULES = (
    ("email", 2, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"),
    ("ip_address", 1, r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    ("assigned_secret", 4, r"(?i)(token|secret|password|api_key) *[=:] *.[A-Za-z0-9]{8}"),
    ("card_number", 3, r"[0-9]{16}"),
)
PAGE_RULES = (
    ("script_tag", 3, r"(?i)<script"),
    ("inline_handler", 4, r"(?i) on[a-z]+ *="),
    ("script_url", 4, r"(?i)javascript:"),
    ("frame", 2, r"(?i)<iframe"),
)
CHUNK, OVERLAP = 200, 20


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def _found(column: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all({column}, '{quoted}'))"


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, regexp_extract_all(coalesce(text, ''), '[^A-Za-z0-9_ \t\r\n]') AS s FROM documents),
    c AS (SELECT doc_id, len(list_distinct(s)) AS n1, len(list_distinct(w)) AS n2, len(s) AS t1, len(w) AS t2 FROM t)
    SELECT doc_id, n1, n2, t1, t2, round(CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2(n1 + n2) ELSE 0 END, 4) AS volume,
        round(CASE WHEN n2 > 0 THEN n1 / 2 * t2 / n2 ELSE 0 END, 4) AS difficulty FROM c""")
def halstead_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halstead counts of each text: signs as operators, words as operands; no shuffle."""
    t = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"), F.regexp_extract_all("text", F.lit(SIGN), 0).alias("s"))
    c = t.select("doc_id", *(F.size(x).cast("long").alias(n) for n, x in (("n1", F.array_distinct("s")), ("n2", F.array_distinct("w")), ("t1", F.col("s")), ("t2", F.col("w")))))
    made = measures.halstead(*(F.col(x) for x in ("n1", "n2", "t1", "t2")))
    return c.select("*", made["volume"].alias("volume"), made["difficulty"].alias("difficulty"))


@query(f"""SELECT doc_id, round(greatest(0, (171 - 5.2 * ln(greatest({_found("coalesce(text, '')", WORD)} * 8, 1)) - 0.23 * ({_found("coalesce(text, '')", '[.!?]')} + 1)
    - 16.2 * ln(greatest(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_found("coalesce(text, '')", chr(10))} + 1 END, 1))) * 100 / 171), 4) AS maintainability FROM documents""")
def maintainability_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintainability index, eight bits a word as volume, sentences as decisions, lines as size."""
    value = measures.maintainability((tx.count("text", WORD) * 8).cast("double"), tx.count("text", "[.!?]") + 1, tx.lines("text"))
    return _docs(spark, sf_dir).select("doc_id", value.alias("maintainability"))


@query(f"""WITH {_LINES} SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS physical, count_if({_NORMAL} = '') AS blank,
    count_if(regexp_matches(lower(line), '{_LICENSE}')) AS license FROM lines JOIN documents USING (doc_id) GROUP BY lang""")
def loc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by language: all, blank, licence."""
    docs = _docs(spark, sf_dir)
    lines = F.split("text", "\n")
    blank = F.size(F.filter(lines, lambda x: tx.normalized(x) == ""))
    license_ = F.size(F.filter(lines, tx.is_license))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(lines)).alias("physical"), F.sum(blank).alias("blank"), F.sum(license_).alias("license"))


@query("SELECT doc_id, length(coalesce(text, '')) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 20")
def largest_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty longest texts."""
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars")).orderBy(F.col("chars").desc(), "doc_id").limit(20)


@query(r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    k AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\x{00}-\x{7F}]', '', 'g')) AS a, n - length(regexp_replace(t, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g')) AS j, n - length(regexp_replace(t, '[\x{1F300}-\x{1FAFF}]', '', 'g')) AS e FROM c)
    SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, floor(a / 4 + j * 1.5 + e * 3 + (n - a - j - e) / 2)) END::BIGINT AS tokens FROM k""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the length of each kind of character."""
    return _docs(spark, sf_dir).select("doc_id", tx.estimated_tokens("text").alias("tokens"))


TAGS = {"auth": "login|password|token|session", "data": "data|table|query|record", "error": "error|fail|exception", "money": "price|pay|card|account", "network": "http|host|server|mail"}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{t}' END" for t, p in TAGS.items()) + ") AS tags FROM documents")
def semantic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each text, alphabetically."""
    low = F.lower("text")
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws(",", *(F.when(F.rlike(low, F.lit(p)), t) for t, p in TAGS.items())).alias("tags"))


@query("SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part) WHERE word <> '' GROUP BY word")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.word_parts("p_name")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


def _unpivoted(rules, table_name: str, key: str, column: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{r}' AS rule, {s} AS severity, {_found(f'''coalesce({column}, '')''', p)} AS n FROM {table_name}" for r, s, p in rules)


def _findings(df: DataFrame, key: str, column: str, rules) -> DataFrame:
    """(key, rule, severity, n): matches of every rule in every row; one pass over the text."""
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), tx.count(column, p).alias("n")) for r, s, p in rules))
    return df.withColumn(column, F.coalesce(column, F.lit(""))).select(key, F.inline(rows)).where("n > 0")


@query(f"SELECT * FROM ({_unpivoted(TEXT_RULES, 'documents', 'doc_id', 'text')}) WHERE n > 0")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and personal data in texts, by rule."""
    return _findings(_docs(spark, sf_dir), "doc_id", "text", TEXT_RULES)


@query(f"SELECT * FROM ({_unpivoted(PAGE_RULES, 'pages', 'page_id', 'html')}) WHERE n > 0")
def xss_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script injection surfaces of pages, by rule."""
    return _findings(table(spark, sf_dir, "pages"), "page_id", "html", PAGE_RULES)


@query(f"""WITH f AS (SELECT rule, severity, n, page_id AS id, 'page' AS category FROM ({_unpivoted(PAGE_RULES, 'pages', 'page_id', 'html')}) WHERE n > 0
    UNION ALL SELECT rule, severity, n, doc_id, 'text' FROM ({_unpivoted(TEXT_RULES, 'documents', 'doc_id', 'text')}) WHERE n > 0)
    SELECT coalesce(category, 'all') AS category, coalesce(severity, 0) AS severity, count(*) AS findings, count(DISTINCT id) AS places, sum(n)::BIGINT AS matches FROM f GROUP BY GROUPING SETS ((category), (severity), ())""")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings by category, by severity and together, in one pass."""
    pages = xss_findings(spark, sf_dir).withColumnRenamed("page_id", "id").withColumn("category", F.lit("page"))
    texts = secret_findings(spark, sf_dir).withColumnRenamed("doc_id", "id").withColumn("category", F.lit("text"))
    grouped = pages.unionByName(texts).groupingSets([["category"], ["severity"], []], "category", "severity")
    return grouped.agg(F.count("*").alias("findings"), F.countDistinct("id").alias("places"), F.sum("n").alias("matches")).select(
        F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("severity", F.lit(0)).alias("severity"), "findings", "places", "matches"
    )


@query(f"""WITH f AS (SELECT rule, severity, p.page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM ({_unpivoted(PAGE_RULES, 'pages', 'page_id', 'html')}) x JOIN pages p ON p.page_id = x.page_id WHERE n > 0)
    SELECT host, rule, min(page_id) AS first_page, count(*) - 1 AS removed FROM f GROUP BY host, rule""")
def findings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding of each rule on each host, and how many more there were."""
    pages = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    found = _findings(pages.select(F.struct("page_id", "host").alias("at"), "html"), "at", "html", PAGE_RULES)
    return found.groupBy(F.col("at.host").alias("host"), "rule").agg(F.min("at.page_id").alias("first_page"), (F.count("*") - 1).alias("removed"))


@query(rf"""WITH {_LINES}, f AS (SELECT doc_id, n FROM lines WHERE regexp_matches(line, '{TEXT_RULES[0][2]}')), m AS (SELECT doc_id, n FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))
    SELECT doc_id, count(*) AS findings, count_if(EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.n IN (f.n, f.n - 1))) AS suppressed FROM f GROUP BY doc_id""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail lines of each text, and those that a marker on the line or on the one before suppresses; lines never leave their row."""
    lines = F.split("text", "\n")
    email, marker = F.lit(TEXT_RULES[0][2]), F.lit("[0-9]{4}")
    flagged = F.transform(lines, lambda x, i: F.struct(F.rlike(x, email).alias("hit"), (F.rlike(x, marker) | F.coalesce(F.rlike(F.get(lines, i - 1), marker), F.lit(False))).alias("off")))
    hits = F.filter(flagged, lambda x: x["hit"])
    out = _docs(spark, sf_dir).where(F.rlike("text", email)).select("doc_id", hits.alias("hits"))
    return out.select("doc_id", F.size("hits").cast("long").alias("findings"), F.size(F.filter("hits", lambda x: x["off"])).cast("long").alias("suppressed"))


def _line_windows(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """(doc_id, window): hashes of all runs of ``width`` non-blank normalised lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.normalized), lambda x: x != "")
    docs = _docs(spark, sf_dir).select("doc_id", lines.alias("lines")).where(F.size("lines") >= width)
    starts = F.sequence(F.lit(1), F.size("lines") - (width - 1))
    return docs.select("doc_id", F.explode(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("lines", i, width), "\n")))).alias("window"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, {_NORMAL} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM lines WHERE {_NORMAL} <> ''),
    w AS (SELECT a.doc_id, md5(a.line || chr(10) || b.line || chr(10) || c.line) AS h FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.r = a.r + 1 JOIN k c ON c.doc_id = a.doc_id AND c.r = a.r + 2),
    g AS (SELECT h FROM w GROUP BY h HAVING count(*) >= 2)
    SELECT doc_id, count(*) AS cloned_windows FROM w WHERE h IN (SELECT h FROM g) GROUP BY doc_id""")
def type1_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines that stand more than once, by text. Windows are counted per text before they meet."""
    windows = stored(_line_windows(spark, sf_dir, 3).groupBy("doc_id", "window").agg(F.count("*").alias("n")))
    often = stored(windows.groupBy("window").agg(F.sum("n").alias("all")).where(F.col("all") >= 2).select("window"))
    return windows.join(often, "window").groupBy("doc_id").agg(F.sum("n").alias("cloned_windows"))


@query(r"""WITH t AS (SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', '0', 'g'), '[A-Z][a-z]*', 'W', 'g')) AS h FROM documents)
    SELECT min(doc_id) AS first_doc, count(*) AS members FROM t GROUP BY h HAVING count(*) >= 2""")
def type2_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that agree but for numbers and capitalised words."""
    plain = F.regexp_replace(F.regexp_replace("text", "[0-9]+", "0"), "[A-Z][a-z]*", "W")
    hashed = _docs(spark, sf_dir).select("doc_id", F.sha2(plain, 256).alias("h"))
    return hashed.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members")).where("members >= 2").drop("h")


@query("SELECT min(doc_id) AS first_doc, count(*) AS copies, count(DISTINCT source) AS sources FROM documents GROUP BY coalesce(text, '') HAVING count(*) >= 2")
def content_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; only hashes are shuffled, partly counted before."""
    hashed = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return hashed.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources")).where("copies >= 2").drop("h")


@query("SELECT count(*) AS docs, count(DISTINCT coalesce(text, '')) AS texts, round(1 - count(DISTINCT coalesce(text, '')) / count(*), 6) AS dedup_ratio FROM documents")
def dedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts that are copies."""
    return _docs(spark, sf_dir).select(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("docs"), F.countDistinct("h").alias("texts")).withColumn("dedup_ratio", F.round(1 - F.col("texts") / F.col("docs"), 6))


@query(f"""WITH t AS (SELECT doc_id, {_found("coalesce(text, '')", WORD)} AS words FROM documents),
    c AS (SELECT doc_id, words, unnest(generate_series(0, greatest(0, ceil((words - {OVERLAP}) / {CHUNK - OVERLAP})::BIGINT - 1))) AS chunk FROM t WHERE words > 0)
    SELECT doc_id, chunk, chunk * {CHUNK - OVERLAP} AS first_word, least(words, chunk * {CHUNK - OVERLAP} + {CHUNK}) AS end_word FROM c""")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 200 words, 20 of them shared with the chunk before."""
    step = CHUNK - OVERLAP
    t = _docs(spark, sf_dir).select("doc_id", tx.count("text", WORD).alias("words")).where("words > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("words") - OVERLAP) / step) - 1).cast("long")
    c = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return c.select("doc_id", "chunk", (F.col("chunk") * step).alias("first_word"), F.least("words", F.col("chunk") * step + CHUNK).alias("end_word"))


@query("""WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT page_id, string_split(path, '/') AS parts FROM p WHERE path <> ''),
    d AS (SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS depth FROM s)
    SELECT array_to_string(parts[1:depth], '/') AS prefix, depth, count(*) AS pages FROM d GROUP BY ALL""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of page addresses: every prefix, its depth and the pages under it."""
    parts = F.split(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^?#]*)", 1), "/")
    pages = table(spark, sf_dir, "pages").select(parts.alias("parts")).where("parts[0] != ''")
    prefixes = F.transform("parts", lambda _, i: F.struct(F.array_join(F.slice("parts", 1, i + 1), "/").alias("prefix"), (i + 1).cast("long").alias("depth")))
    return pages.select(F.inline(prefixes)).groupBy("prefix", "depth").agg(F.count("*").alias("pages"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '://(localhost|127[.]|10[.]|192[.]168[.]|169[.]254[.])') THEN 'internal' WHEN url LIKE 'http://%' THEN 'clear_text' WHEN url LIKE 'https://%' THEN 'ok' ELSE 'other' END AS target FROM pages""")
def ssrf_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages by the danger of fetching them."""
    inside = F.rlike(F.lower("url"), F.lit("://(localhost|127[.]|10[.]|192[.]168[.]|169[.]254[.])"))
    target = F.when(inside, "internal").when(F.col("url").startswith("http://"), "clear_text").when(F.col("url").startswith("https://"), "ok").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", target.alias("target"))


@query("""WITH l AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS module, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS uses FROM pages)
    SELECT uses, count(*) AS ca FROM l GROUP BY uses""")
def page_link_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets and the number of hosts that use them."""
    links = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("module"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), 1)).alias("uses"))
    return links.distinct().groupBy("uses").agg(F.count("*").alias("ca"))


@query("SELECT source, arg_max(lang, (n, lang)) AS lang, sum(n)::BIGINT AS docs FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def project_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest language of each source; of equals the last by name."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.max(F.struct("n", "lang"))["lang"].alias("lang"), F.sum("n").alias("docs"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN length(text) > 8000 THEN 'long' END, CASE WHEN len(string_split(text, chr(10))) > 40 THEN 'many_lines' END,
    CASE WHEN (SELECT max(length(x)) FROM unnest(string_split(text, chr(10))) u(x)) > 1000 THEN 'wide' END) AS issues FROM documents WHERE text IS NOT NULL""")
def size_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which size thresholds each text exceeds."""
    lines = F.split("text", "\n")
    widest = F.array_max(F.transform(lines, F.length))
    issues = F.concat_ws(",", F.when(F.length("text") > 8000, "long"), F.when(F.size(lines) > 40, "many_lines"), F.when(widest > 1000, "wide"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", issues.alias("issues"))


@query("""SELECT a.conv_id, a.turn AS def_turn, coalesce(min(b.turn), -1) AS use_turn FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant' WHERE a.role = 'user' GROUP BY ALL""")
def def_use_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn and the next assistant turn of its conversation, -1 if none follows."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, Window.unboundedFollowing)
    used = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)
    return table(spark, sf_dir, "conversations").withColumn("use_turn", used).where("role = 'user'").select("conv_id", F.col("turn").alias("def_turn"), F.coalesce("use_turn", F.lit(-1)).alias("use_turn")).distinct()


@query()
def type3_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by groups of equal word sequences, and the groups within a fifth of edits of each other."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0).alias("tokens"))
    return clones.near_sequences(items, 0.8)
