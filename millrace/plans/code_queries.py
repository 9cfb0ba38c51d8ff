"""Queries over a source tree that is written from the tables, through the Python front end.

Each customer is a module, each order a function of it (a method where the
customer's number is even), each line of the order a branch ('R'), a loop
('A') or a call ('N'). The front end parses the texts; the SQL twins never see
a text: they say from the tables what the language's rules make of such code.
Modules of some customers do not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.lineage import stored
from millrace.operators import code_metrics, context, exports, findings, graph, intervals
from millrace.plans.program_queries import _PROGRAMS, Programs
from millrace.sources import python_code, python_flow
from millrace.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    """Register a query beside its SQL."""

    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the modules."""
    ranked = Programs(spark, sf_dir).blocks.withColumn("i", F.row_number().over(Window.partitionBy("func").orderBy("block")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("func"), F.col("o_custkey").alias("cust"), (F.col("o_orderstatus") == "P").alias("is_test"), F.col("o_orderpriority").startswith("1").alias("doc"))
    of = Window.partitionBy("cust").orderBy("func")
    named = orders.join(ranked.select("func").distinct(), "func").withColumn("name", F.concat(F.when(F.col("is_test"), "test_f").otherwise("f"), "func"))
    places = stored(named.withColumns({"r": F.row_number().over(of) - 1, "next": F.lead("name").over(of)}).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")), "cust"))
    following = places.where("r = 0").select((F.col("cust") - 1).alias("cust"), F.concat(F.lit("from n"), "nation", F.lit(".m"), "cust", F.lit(" import "), "name", F.lit(" as imported")).alias("import"))
    functions = places.join(following, "cust", "left").withColumn("callee", F.when((F.col("r") % 4 < 3) & F.col("next").isNotNull(), F.col("next")).when(F.col("next").isNull() & F.col("import").isNotNull(), "imported").otherwise("len"))
    lines = ranked.join(functions.select("func", "is_test", "callee"), "func")
    test, use, set_ = F.col("flag"), F.col("use"), F.col("def")
    first = F.when(test == "R", F.concat(F.lit("if "), use, F.lit(":"))).when(test == "A", F.concat(F.lit("while "), use, F.lit(":"))).otherwise(F.concat(set_, F.lit(" = "), "callee", F.lit("("), use, F.lit(")")))
    shell = F.concat(F.lit('os.system("ls")'), F.when(F.col("i") % 2 == 0, "  # nosec").otherwise(""))
    second = F.when(test == "R", F.concat(F.lit("    "), set_, F.lit(" = "), use, F.lit(" + "), F.col("value"))).when(test == "A", F.concat(F.lit("    "), set_, F.lit(" = "), use, F.lit(" - 1")))
    second = second.when((F.col("value") == 2) & F.col("is_test"), F.concat(F.lit("assert "), use)).when(F.col("value") == 0, shell).otherwise("pass")
    bodies = lines.groupBy("func").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", first.alias("a"), second.alias("b")))), lambda s: F.array(s["a"], s["b"]))).alias("body"))
    method = F.col("cust") % 2 == 0
    head = F.concat(F.lit("def "), "name", F.when(method, "(self, a, b):").otherwise("(a, b):"))
    inner = F.concat(F.array(F.when(F.col("doc"), '"""An order."""').otherwise("pass"), F.lit("v0 = v1 = v2 = v3 = a")), "body", F.array(F.lit("return v0")))
    code = F.concat(F.array(head), F.transform(inner, lambda x: F.concat(F.lit("    "), x)))
    code = F.concat(F.when(method, F.transform(code, lambda x: F.concat(F.lit("    "), x))).otherwise(code), F.array(F.lit("")))
    written = functions.join(bodies, "func").select("cust", "nation", "func", F.coalesce("import", F.lit("import hashlib")).alias("import"), code.alias("code"))
    modules = written.groupBy("cust", "nation", "import").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("func", "code"))), lambda s: s["code"])).alias("code"))
    top = F.concat(F.array(F.lit("import os"), F.col("import"), F.lit("")), F.when(method, F.array(F.concat(F.lit("class C"), "cust", F.lit(":")))).otherwise(F.array().cast("array<string>")))
    broken = F.when(F.col("cust") % 50 == 7, F.array(F.lit("def (:"))).otherwise(F.array().cast("array<string>"))
    return modules.select(F.concat(F.lit("n"), "nation", F.lit("/m"), "cust", F.lit(".py")).alias("path"), F.array_join(F.concat(top, "code", broken), "\n").alias("text"))


_TREE = f"""{_PROGRAMS},
    named AS (SELECT f.func, o_custkey AS cust, o_orderstatus = 'P' AS is_test, o_orderpriority LIKE '1%' AS doc, f.k, CASE WHEN o_orderstatus = 'P' THEN 'test_f' ELSE 'f' END || f.func AS name, c_nationkey AS nation
        FROM (SELECT func, count(*) AS k FROM b GROUP BY func) f JOIN orders ON o_orderkey = f.func JOIN customer ON c_custkey = o_custkey),
    laid AS (SELECT *, row_number() OVER w - 1 AS r, lead(name) OVER w AS next, 4 + CASE WHEN cust % 2 = 0 THEN 1 ELSE 0 END + coalesce(sum(2 * k + 5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line,
        'n' || nation || '/m' || cust || '.py' AS file, CASE WHEN cust % 2 = 0 THEN 'C' || cust || '.' ELSE '' END || name AS qualified FROM named WINDOW w AS (PARTITION BY cust ORDER BY func)),
    every AS (SELECT l.*, l.line + 2 * l.k + 3 AS last_line, y.name AS imports, y.nation AS from_nation, y.cust AS from_cust, l.file || '::' || l.qualified AS node,
        CASE WHEN l.r % 4 < 3 AND l.next IS NOT NULL THEN l.next WHEN l.next IS NULL AND y.name IS NOT NULL THEN y.name END AS callee FROM laid l LEFT JOIN laid y ON y.cust = l.cust + 1 AND y.r = 0),
    fn AS (SELECT * FROM every WHERE cust % 50 <> 7),
    item AS (SELECT b.*, row_number() OVER (PARTITION BY func ORDER BY block) AS i FROM b),
    it AS (SELECT item.*, fn.node, fn.file, fn.is_test, fn.callee, fn.line + 1 + 2 * i AS ln FROM item JOIN fn USING (func)),
    size AS (SELECT fn.func, count(*) FILTER (flag IN ('R', 'A')) AS branches, count(*) FILTER (flag NOT IN ('R', 'A') AND value = 2 AND it.is_test) AS asserts FROM fn JOIN it USING (func) GROUP BY fn.func),
    calls AS (SELECT DISTINCT it.node AS src, t.node AS dst, it.ln AS line, it.file, t.file AS to_file FROM it JOIN fn t ON t.name = it.callee WHERE it.flag NOT IN ('R', 'A'))"""
# Lines as nodes: 0 the first, 1 the common setting, then two lines an item, and the return.
_FLOW = """step AS (SELECT func, line AS src, line + 2 AS dst FROM fn UNION ALL SELECT func, line + 2, line + 3 FROM fn UNION ALL SELECT func, ln, ln + 1 FROM it UNION ALL SELECT func, ln + 1, ln + 2 FROM it WHERE flag <> 'A'
        UNION ALL SELECT func, ln + 1, ln FROM it WHERE flag = 'A' UNION ALL SELECT func, ln, ln + 2 FROM it WHERE flag IN ('R', 'A')),
    sets AS (SELECT func, line AS ln, unnest(CASE WHEN cust % 2 = 0 THEN ['self', 'a', 'b'] ELSE ['a', 'b'] END) AS variable FROM fn UNION ALL SELECT func, line + 2, unnest(['v0', 'v1', 'v2', 'v3']) FROM fn
        UNION ALL SELECT func, CASE WHEN flag IN ('R', 'A') THEN ln + 1 ELSE ln END, def FROM it),
    uses AS (SELECT func, line + 2 AS ln, 'a' AS variable FROM fn UNION ALL SELECT func, last_line, 'v0' FROM fn UNION ALL SELECT func, ln, use FROM it
        UNION ALL SELECT func, ln + 1, use FROM it WHERE flag IN ('R', 'A') OR value = 2 AND is_test),
    reaching AS (SELECT s.func, s.variable, s.ln AS def_line, step.dst AS ln FROM sets s JOIN step ON step.func = s.func AND step.src = s.ln
        UNION SELECT r.func, r.variable, r.def_line, step.dst FROM reaching r JOIN step ON step.func = r.func AND step.src = r.ln WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.func = r.func AND s.ln = r.ln AND s.variable = r.variable)),
    dfg AS (SELECT DISTINCT r.func, r.variable, r.def_line, r.ln AS use_line FROM reaching r JOIN uses u ON u.func = r.func AND u.ln = r.ln AND u.variable = r.variable)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(python_code.modules(source_tree(spark, sf_dir)))


def _flows(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    return python_flow.flows(source_tree(spark, sf_dir), (part,))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_code.relation(_parsed(spark, sf_dir), "functions")


@query(f"""WITH {_TREE} SELECT file, qualified, CASE WHEN cust % 2 = 0 THEN 'C' || cust END AS owner, CASE WHEN cust % 2 = 0 THEN 3 ELSE 2 END AS n_params, line AS start_line, last_line AS end_line,
    1 + branches + asserts AS cyclomatic, branches AS cognitive, CASE WHEN branches > 0 THEN 1 ELSE 0 END AS nesting, 1 AS returns FROM fn JOIN size USING (func)""")
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their places and measures."""
    return _functions(spark, sf_dir).select("file", "qualified", "owner", F.size("params").alias("n_params"), "start_line", "end_line", "cyclomatic", "cognitive", "nesting", "returns")


@query(f"""WITH {_TREE} SELECT DISTINCT file, 'os' AS module, NULL AS name, 'os' AS alias, 0 AS level, 1 AS line FROM fn
    UNION ALL SELECT file, coalesce('n' || from_nation || '.m' || from_cust, 'hashlib'), imports, CASE WHEN imports IS NULL THEN 'hashlib' ELSE 'imported' END, 0, 2 FROM fn WHERE r = 0""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file imports."""
    return python_code.relation(_parsed(spark, sf_dir), "imports")


@query(f"WITH {_TREE} SELECT 'n' || from_nation || '/m' || from_cust || '.py' AS file, file AS importer, imports AS name FROM fn WHERE r = 0 AND imports IS NOT NULL")
def code_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of the tree import which: imported modules joined with the files that hold them."""
    parsed = _parsed(spark, sf_dir)
    held = parsed.select(F.col("path").alias("file"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"))
    return python_code.relation(parsed, "imports").withColumnRenamed("file", "importer").join(held, "module").select("file", "importer", "name")


@query(f"WITH {_TREE} SELECT DISTINCT file AS path FROM every WHERE cust % 50 = 7")
def code_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse."""
    return _parsed(spark, sf_dir).where("error is not null").select("path")


@query(f"WITH {_TREE} SELECT src, dst, line FROM calls")
def code_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved calls."""
    return python_code.call_edges(_parsed(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TREE}, live AS (SELECT node FROM fn WHERE is_test UNION SELECT dst FROM live JOIN calls ON src = node)
    SELECT node, CASE WHEN node IN (SELECT dst FROM calls) THEN 'only_by_dead' ELSE 'never_called' END AS reason FROM fn WHERE node NOT IN (SELECT node FROM live)""")
def code_dead_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that no test reaches, with the reason."""
    parsed = _parsed(spark, sf_dir)
    return python_code.dead_functions(parsed, stored(python_code.call_edges(parsed)))


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT DISTINCT dst AS node, 0 AS d FROM calls JOIN fn ON fn.node = dst WHERE fn.func % 10 = 3 UNION SELECT src, d + 1 FROM up JOIN calls ON dst = node WHERE d < 60)
    SELECT node, min(d) AS distance FROM up GROUP BY node""")
def code_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls the functions of orders whose number ends in 3, directly or not, by distance."""
    edges = stored(python_code.call_edges(_parsed(spark, sf_dir)).select("src", "dst").distinct())
    return graph.reach(edges, edges.where("dst rlike '[.:]?(test_)?f[0-9]*3$'").select(F.col("dst").alias("node")).distinct(), backward=True)


# A branch makes two blocks, a loop three; what follows goes on in the last of them.
_BLOCKS = """made AS (SELECT node, func, i, flag, 3 + coalesce(sum(CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 0 END) OVER (PARTITION BY func ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM it),
    total AS (SELECT node, func, max(c + CASE flag WHEN 'R' THEN 2 WHEN 'A' THEN 3 ELSE 0 END) AS c FROM made GROUP BY ALL)"""


@query(f"""WITH {_TREE}, {_BLOCKS} SELECT node AS func, 0 AS block, 'entry' AS block_type FROM total UNION ALL SELECT node, 1, 'exit' FROM total UNION ALL SELECT node, 2, 'body' FROM total
    UNION ALL SELECT node, c, 'body' FROM made WHERE flag = 'R' UNION ALL SELECT node, c + 1, 'body' FROM made WHERE flag = 'R' UNION ALL SELECT node, c, 'loop' FROM made WHERE flag = 'A' UNION ALL SELECT node, c + 1, 'body' FROM made WHERE flag = 'A' UNION ALL SELECT node, c + 2, 'body' FROM made WHERE flag = 'A'""")
def code_cfg_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic blocks."""
    return python_flow.relation(_flows(spark, sf_dir, "blocks"), "blocks").select("func", "block", "block_type")


@query(f"""WITH {_TREE}, {_BLOCKS} SELECT node AS func, 0 AS src, 2 AS dst, NULL AS label FROM total UNION ALL SELECT node, c - 1, 1, 'return' FROM total
    UNION ALL SELECT node, c - 1, c, 'true' FROM made WHERE flag = 'R' UNION ALL SELECT node, c - 1, c + 1, 'false' FROM made WHERE flag = 'R' UNION ALL SELECT node, c, c + 1, NULL FROM made WHERE flag = 'R'
    UNION ALL SELECT node, c - 1, c, NULL FROM made WHERE flag = 'A' UNION ALL SELECT node, c, c + 1, 'true' FROM made WHERE flag = 'A' UNION ALL SELECT node, c + 1, c, 'back' FROM made WHERE flag = 'A' UNION ALL SELECT node, c, c + 2, 'false' FROM made WHERE flag = 'A'""")
def code_cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-flow edges."""
    return python_flow.relation(_flows(spark, sf_dir, "edges"), "edges").select("func", "src", "dst", "label")


@query(f"WITH RECURSIVE {_TREE}, {_FLOW} SELECT fn.node AS func, variable, def_line, use_line FROM dfg JOIN fn USING (func)")
def code_dfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow edges: the line that sets a variable and a line that may use the value."""
    return python_flow.data_flow(_flows(spark, sf_dir, "data_flow"))


@query(f"""WITH {_TREE} SELECT node AS func, ln AS src, ln + 1 AS dst, 'true' AS label FROM it WHERE flag IN ('R', 'A') UNION ALL SELECT node, ln, ln, 'true' FROM it WHERE flag = 'A'""")
def code_control_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that run or not as a branch or a loop decides, a loop's head itself among them."""
    return python_flow.control_flow_dependence(_flows(spark, sf_dir, "control"))


@query(f"WITH RECURSIVE {_TREE}, {_FLOW} SELECT DISTINCT fn.node AS func, s.variable, s.ln AS line FROM sets s JOIN fn USING (func) WHERE NOT EXISTS (SELECT 1 FROM dfg WHERE dfg.func = s.func AND dfg.variable = s.variable AND dfg.def_line = s.ln)")
def code_unused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and settings whose value no line uses."""
    return python_flow.unused_settings(_flows(spark, sf_dir, "unused"))


@query(f"""WITH RECURSIVE {_TREE}, {_FLOW}, s AS (SELECT func, last_line AS line, 0 AS d FROM fn UNION SELECT dfg.func, dfg.def_line, d + 1 FROM s JOIN dfg ON dfg.func = s.func AND dfg.use_line = s.line WHERE d < 20)
    SELECT fn.node AS func, s.line, min(d) AS distance FROM s JOIN fn USING (func) GROUP BY ALL""")
def code_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the value that each function returns depends on."""
    return python_flow.result_slices(_flows(spark, sf_dir, "result_slice"))


@query(f"""WITH {_TREE} SELECT 'PY-SYSTEM' AS rule, 'command_injection' AS category, 4 AS severity, 78 AS cwe, file, ln + 1 AS line, i % 2 = 0 AS suppressed FROM it WHERE flag NOT IN ('R', 'A') AND value = 0""")
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the call and line rules, with what comments suppress."""
    files = stored(source_tree(spark, sf_dir))
    found = findings.call_findings(python_code.relation(python_code.modules(files, ("calls",)), "calls")).unionByName(findings.line_findings(files))
    return findings.suppressed(found, findings.markers(files)).select("rule", "category", "severity", "cwe", "file", "line", "suppressed")


@query(f"""WITH {_TREE} SELECT file, qualified, 2 * k + 4 AS length, 2 AS n_params, CASE WHEN 1 + branches + asserts <= 10 THEN 'low' ELSE 'moderate' END AS risk,
    concat_ws('+', CASE WHEN 2 * k + 4 > 14 THEN 'long' END, CASE WHEN 1 + branches + asserts > 4 THEN 'complex' END) AS issues FROM fn JOIN size USING (func)""")
def code_function_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, parameters, risk and exceeded thresholds of functions."""
    some = (("long", "length", 14), ("complex", "cyclomatic", 4), ("many_parameters", "n_params", 2))
    return code_metrics.function_report(_functions(spark, sf_dir), some).select("file", "qualified", "length", "n_params", "risk", F.array_join("issues", "+").alias("issues"))


@query(f"""WITH {_TREE}, f AS (SELECT file, cust, count(*) AS n, sum(2 * k + 5) AS code_lines FROM every GROUP BY ALL), m AS (SELECT file, round(avg(1 + branches + asserts), 4) AS mean, max(1 + branches + asserts) AS most FROM fn JOIN size USING (func) GROUP BY file)
    SELECT f.file AS path, 3 + (cust % 2 = 0)::INT + code_lines + (cust % 50 = 7)::INT AS physical, 1 + n AS blank, 0 AS comment, 2 + (cust % 2 = 0)::INT + code_lines - n + (cust % 50 = 7)::INT AS code, CASE WHEN cust % 50 = 7 THEN 0 ELSE n END AS functions, m.mean AS mean_complexity, m.most AS most_complex
    FROM f LEFT JOIN m ON m.file = f.file""")
def code_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, functions and complexity of files."""
    files = stored(source_tree(spark, sf_dir))
    functions = python_code.relation(python_code.modules(files, ("functions",)), "functions")
    return code_metrics.file_report(functions, files).select("path", "physical", "blank", "comment", "code", "functions", "mean_complexity", "most_complex")


@query(f"""WITH {_TREE}, c AS (SELECT file, 'C' || cust AS owner, count(*) AS methods, sum(1 + branches + asserts)::BIGINT AS complexity FROM fn JOIN size USING (func) WHERE cust % 2 = 0 GROUP BY ALL),
    s AS (SELECT *, greatest(0, methods - 8) * 2 + greatest(0, complexity - 40) / 5 AS score FROM c) SELECT file, owner, methods, complexity, score::DOUBLE AS score, score >= 10 AS god FROM s""")
def code_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, complexity and score of classes."""
    return code_metrics.class_report(_functions(spark, sf_dir), many=8)


@query(f"WITH {_TREE} SELECT file, CASE WHEN cust % 2 = 0 THEN 'method' ELSE 'function' END AS kind, count(*) FILTER (doc) AS documented, count(*) AS total FROM fn GROUP BY ALL")
def code_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions and methods of files."""
    return code_metrics.documentation(_functions(spark, sf_dir))


@query(f"WITH {_TREE} SELECT file, qualified AS test, asserts AS assertions, 0 AS mocks, asserts = 0 AS weak FROM fn JOIN size USING (func) WHERE is_test")
def code_weak_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of tests."""
    files = stored(source_tree(spark, sf_dir))
    parsed = stored(python_code.modules(files))
    return code_metrics.weak_tests(python_code.relation(parsed, "functions"), python_code.relation(parsed, "calls"), files)


@query(f"""WITH {_TREE}, d AS (SELECT DISTINCT file, to_file FROM calls WHERE file <> to_file), m AS (SELECT file FROM d UNION SELECT to_file FROM d),
    c AS (SELECT m.file AS module, (SELECT count(*) FROM d WHERE d.file = m.file) AS ce, (SELECT count(*) FROM d WHERE d.to_file = m.file) AS ca FROM m) SELECT module, ce, ca, ce / (ce + ca) AS instability FROM c""")
def code_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling of files through calls."""
    return code_metrics.file_coupling(python_code.call_edges(_parsed(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_TREE}, ce AS (SELECT DISTINCT src, dst FROM calls), up AS (SELECT node AS entry, node, 0 AS d FROM fn WHERE func % 10 = 1 UNION ALL SELECT entry, dst, d + 1 FROM up JOIN ce ON src = node WHERE d < 3),
    nearest AS (SELECT entry, node, min(d) AS d FROM up GROUP BY ALL),
    summed AS (SELECT n.*, 2 * fn.k + 4 AS lines, sum(2 * fn.k + 4) OVER (PARTITION BY entry ORDER BY d, n.node) AS total FROM nearest n JOIN fn ON fn.node = n.node)
    SELECT entry, coalesce(string_agg(node, ' ' ORDER BY d, node) FILTER (d > 0), '') AS functions, count(*) FILTER (d > 0) AS n, sum(lines)::BIGINT AS lines FROM summed WHERE total <= 40 OR d = 0 GROUP BY entry""")
def code_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For functions of orders whose number ends in 1: what they call in up to three steps, within 40 lines, nearest first."""
    files = stored(source_tree(spark, sf_dir))
    parsed = stored(python_code.modules(files))
    functions = stored(python_code.relation(parsed, "functions"))
    entries = functions.where("name rlike '1$'").select(F.concat_ws("::", "file", "qualified").alias("node"))
    found = context.contexts(python_code.call_edges(parsed), entries, context.sources(functions, files), depth=3, budget=40)
    return found.select("entry", F.array_join("functions", " ").alias("functions"), "n", "lines")


_MODULES = """d AS (SELECT o_custkey AS module, 'f' || (o_orderkey % 20) AS name, max(10 + o_orderkey % 7)::INT AS line FROM orders GROUP BY ALL), cs AS (SELECT DISTINCT module FROM d),
    im AS (SELECT module, module + 1 AS source, '*' AS name, NULL::VARCHAR AS alias, 1 AS line FROM cs WHERE module % 3 = 0 UNION ALL SELECT module, module + 1, '*', NULL::VARCHAR, 14 FROM cs WHERE module % 3 = 1 UNION ALL SELECT module, module + 2, 'f3', 'g', 12 FROM cs WHERE module % 5 = 0),
    held AS (SELECT module, name FROM d UNION SELECT module, alias FROM im WHERE alias IS NOT NULL UNION SELECT im.module, held.name FROM held JOIN im ON im.source = held.module AND im.name = '*'),
    bound AS (SELECT module, name, NULL::BIGINT AS source, NULL::VARCHAR AS source_name, line FROM d UNION ALL SELECT module, alias, source, name, line FROM im WHERE alias IS NOT NULL UNION ALL SELECT im.module, h.name, im.source, h.name, im.line FROM im JOIN held h ON h.module = im.source WHERE im.name = '*'),
    last AS (SELECT * FROM bound QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY line DESC, source IS NULL DESC, source DESC) = 1)"""


@query(f"""WITH RECURSIVE {_MODULES}, org AS (SELECT module, name, module AS origin, name AS origin_name FROM last WHERE source IS NULL UNION SELECT module, name, source, source_name FROM last WHERE source IS NOT NULL AND source NOT IN (SELECT module FROM cs)
        UNION SELECT l.module, l.name, org.origin, org.origin_name FROM org JOIN last l ON l.source = org.module AND l.source_name = org.name)
    SELECT module, name, origin, origin_name FROM org""")
def name_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where names of modules are defined: customers as modules, their orders' numbers as names, star imports before or after, and a named one."""
    orders = table(spark, sf_dir, "orders")
    line = (F.col("o_orderkey") % 7 + 10).cast("int")
    definitions = stored(orders.groupBy(F.col("o_custkey").alias("module"), F.concat(F.lit("f"), F.col("o_orderkey") % 20).alias("name")).agg(F.max(line).alias("line")))
    modules = definitions.select("module").distinct()
    none = F.lit(None).cast("string")
    star = modules.where("module % 3 < 2").select("module", (F.col("module") + 1).alias("source"), F.lit("*").alias("name"), none.alias("alias"), F.when(F.col("module") % 3 == 0, 1).otherwise(14).alias("line"))
    named = modules.where("module % 5 = 0").select("module", (F.col("module") + 2).alias("source"), F.lit("f3").alias("name"), F.lit("g").alias("alias"), F.lit(12).alias("line"))
    return exports.origins(definitions, stored(star.unionByName(named)))


@query(f"""WITH RECURSIVE {_PROGRAMS}, item AS (SELECT func, row_number() OVER (PARTITION BY func ORDER BY block) AS i, flag, value, 5 + 10 * value AS goal FROM b),
    st AS (SELECT DISTINCT func, 1::BIGINT AS i, 0::BIGINT AS lo, 0::BIGINT AS hi FROM item
        UNION ALL SELECT st.func, st.i + 1, CASE flag WHEN 'A' THEN value WHEN 'N' THEN greatest(lo, goal) ELSE lo END,
            CASE flag WHEN 'A' THEN value WHEN 'N' THEN greatest(hi, goal) ELSE CASE WHEN value = 0 THEN 1000000000 ELSE hi + value END END FROM st JOIN item USING (func, i)),
    met AS (SELECT * FROM st JOIN item USING (func, i)),
    found AS (SELECT func, 2 * i + 1 AS line, lo, CASE WHEN flag = 'N' THEN greatest(hi, goal) ELSE 1000000000 END AS hi FROM met WHERE flag = 'N' OR flag = 'R' AND value = 0
        UNION ALL SELECT func, 2 * i + 2, lo, goal - 1 FROM met WHERE flag = 'N' AND lo < goal
        UNION ALL SELECT func, 2 * i + 2, lo, CASE WHEN value = 0 THEN 1000000000 ELSE hi END FROM met WHERE flag = 'R')
    SELECT 'o' || func || '.py::f' AS func, line, lo AS low, CASE WHEN hi < 1000000000 THEN hi END AS high FROM found""")
def code_value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a counter may hold at loop heads and in the bodies of loops and branches (high of null: no bound), of functions that count up to goals, branch on a parameter and set the counter anew; the SQL steps through the code."""
    ranked = Programs(spark, sf_dir).blocks.withColumn("i", F.row_number().over(Window.partitionBy("func").orderBy("block")))
    flag, value = F.col("flag"), F.col("value").cast("string")
    goal = (5 + 10 * F.col("value")).cast("string")
    head = F.when(flag == "A", F.concat(F.lit("x = "), value)).when(flag == "N", F.concat(F.lit("while x < "), goal, F.lit(":"))).when(F.col("value") == 0, F.lit("while a:"))
    head = head.otherwise(F.concat(F.lit("if a > "), F.col("i").cast("string"), F.lit(":")))
    body = F.when(flag == "A", F.lit("pass")).when((flag == "R") & (F.col("value") > 0), F.concat(F.lit("    x = x + "), value)).otherwise(F.lit("    x += 1"))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", head.alias("a"), body.alias("b")))), lambda s: F.array(F.concat(F.lit("    "), s["a"]), F.concat(F.lit("    "), s["b"]))))
    texts = ranked.groupBy("func").agg(lines.alias("lines")).select(F.concat(F.lit("o"), "func", F.lit(".py")).alias("path"), F.array_join(F.concat(F.array(F.lit("def f(a):"), F.lit("    x = 0")), "lines", F.array(F.lit("    return x"))), "\n").alias("text"))
    parsed = stored(python_flow.flows(texts, ("ranges", "lines", "blocks", "edges")))
    found = python_flow.value_ranges(parsed).where("variable = 'x'")
    begins = python_flow.relation(parsed, "lines").groupBy("func", "block").agg(F.min_by("line", "nth").cast("long").alias("line"))
    loops = python_flow.relation(parsed, "blocks").where("block_type = 'loop'").select("func", "block")
    inside = python_flow.relation(parsed, "edges").where("label = 'true'").select("func", F.col("dst").alias("block"))
    asked = begins.join(loops.unionByName(inside), ["func", "block"], "left_semi")
    return found.join(asked, ["func", "block"]).select("func", "line", F.col("low").cast("long").alias("low"), F.when(F.col("high") < intervals.INFINITY, F.col("high").cast("long")).alias("high"))
