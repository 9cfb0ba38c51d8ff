"""Queries over programs: control flow, data flow, slices, constants, ranges, traversals, sinks.

The tables stand for programs: an order is a function, its line numbers are
basic blocks. A block uses one variable, then sets one to a value; control goes
to the next block, may skip one ('R') or go back to the first ('A'). All
functions are analysed at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import by_function, dataflow, findings, intervals, measures, nearest, program, traversal
from millrace.sources.tables import table

QUERIES, SQL = {}, {}

_PROGRAMS = """b AS (SELECT l_orderkey AS func, l_linenumber::BIGINT AS block, 'v' || (min(l_suppkey) % 4) AS def, 'v' || (min(l_partkey) % 4) AS use, min(l_quantity)::BIGINT % 3 AS value, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
    n AS (SELECT *, lead(block) OVER w AS following, lead(block, 2) OVER w AS skipped, min(block) OVER (PARTITION BY func) AS first, max(block) OVER (PARTITION BY func) AS last FROM b WINDOW w AS (PARTITION BY func ORDER BY block)),
    e AS (SELECT func, block AS src, following AS dst FROM n WHERE following IS NOT NULL
        UNION SELECT func, block, skipped FROM n WHERE skipped IS NOT NULL AND flag = 'R'
        UNION SELECT func, block, first FROM n WHERE flag = 'A' AND block > first)"""
_REACHING = """rd AS (SELECT e.func, e.dst AS block, b.def AS variable, b.block AS by FROM b JOIN e ON e.func = b.func AND e.src = b.block
        UNION SELECT e.func, e.dst, rd.variable, rd.by FROM rd JOIN b ON b.func = rd.func AND b.block = rd.block AND b.def <> rd.variable JOIN e ON e.func = rd.func AND e.src = rd.block),
    chains AS (SELECT rd.func, rd.variable, rd.by AS def_block, rd.block AS use_block FROM rd JOIN b ON b.func = rd.func AND b.block = rd.block AND b.use = rd.variable)"""
_LIVE = """live AS (SELECT e.func, e.src AS block, b.use AS fact FROM e JOIN b ON b.func = e.func AND b.block = e.dst
        UNION SELECT e.func, e.src, live.fact FROM live JOIN b ON b.func = live.func AND b.block = live.block AND b.def <> live.fact JOIN e ON e.func = live.func AND e.dst = live.block)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


class Programs:
    """The relations of all functions of a folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        lines = table(spark, sf_dir, "lineitem")
        least = lambda c: F.min(c).cast("long")
        blocks = lines.groupBy(F.col("l_orderkey").alias("func"), F.col("l_linenumber").cast("long").alias("block")).agg(
            F.concat(F.lit("v"), least("l_suppkey") % 4).alias("def"), F.concat(F.lit("v"), least("l_partkey") % 4).alias("use"), (least("l_quantity") % 3).alias("value"), F.min("l_returnflag").alias("flag")
        )
        of = Window.partitionBy("func")
        after = of.orderBy("block")
        self.blocks = blocks.withColumns({"following": F.lead("block").over(after), "skipped": F.lead("block", 2).over(after), "first": F.min("block").over(of), "last": F.max("block").over(of)})

    def to(self, *ways: str) -> Column:
        """The blocks that the named ways lead to: following, skipped, back."""
        conditions = {"following": F.lit(True), "skipped": F.col("flag") == "R", "back": (F.col("flag") == "A") & (F.col("block") > F.col("first"))}
        targets = {"following": "following", "skipped": "skipped", "back": "first"}
        to = F.array(*(F.when(conditions[w], F.col(targets[w])) for w in ways))
        return F.array_compact(to)

    def steps(self, *ways: str) -> DataFrame:
        """(func, src, dst) for the named ways on."""
        return self.blocks.select("func", F.col("block").alias("src"), F.explode(self.to(*ways)).alias("dst")).distinct()

    def functions(self) -> DataFrame:
        """(func, blocks): a function a row, for ``by_function``."""
        return by_function.gathered(self.blocks, self.to("following", "skipped", "back"), F.col("block") == F.col("last"))

    @property
    def edges(self) -> DataFrame:
        return self.steps("following", "skipped", "back")

    def facts(self, column: str) -> DataFrame:
        return self.blocks.select("func", "block", F.col(column).alias("fact"))

    def chains(self) -> DataFrame:
        """(func, variable, def_block, use_block)."""
        named = F.struct(F.col("def").alias("variable"), F.col("block"))
        gen = self.blocks.select("func", "block", named.alias("fact"))
        others = self.blocks.select("func", F.col("def"), F.col("block").alias("by"))
        kill = self.blocks.select("func", "block", "def").join(others, ["func", "def"]).where("block <> by").select("func", "block", F.struct(F.col("def").alias("variable"), F.col("by").alias("block")).alias("fact"))
        uses = self.blocks.select("func", "block", F.col("use").alias("variable"))
        return dataflow.def_use_chains(dataflow.may_forward(self.edges, gen, kill), uses)

    def dependences(self) -> DataFrame:
        return self.chains().select("func", "variable", F.col("def_block").alias("from_line"), F.col("use_block").alias("to_line"))

    def lines(self, column: str) -> DataFrame:
        return self.blocks.select("func", F.col(column).alias("line")).distinct()

    def live(self) -> DataFrame:
        """(func, block, fact): variables that are live where a block ends."""
        return dataflow.may_forward(dataflow.flipped(self.edges), self.facts("use"), self.facts("def"))


@query(f"WITH {_PROGRAMS} SELECT func, src, dst FROM e")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control-flow edges of all functions."""
    return Programs(spark, sf_dir).edges


@query(f"WITH {_PROGRAMS} SELECT n.func, greatest(1, coalesce(max(x.n), 0) - count(*) + 2)::BIGINT AS complexity FROM n LEFT JOIN (SELECT func, count(*) AS n FROM e GROUP BY func) x ON x.func = n.func GROUP BY n.func")
def cyclomatic_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges less blocks and two."""
    p = Programs(spark, sf_dir)
    return program.cyclomatic(p.blocks, p.edges).select("func", F.col("complexity").cast("long").alias("complexity"))


@query(f"WITH {_PROGRAMS} SELECT func, count(*) AS n FROM e WHERE dst <= src GROUP BY func")
def back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that loop, with their edges back: blocks are numbered in order."""
    return Programs(spark, sf_dir).edges.where("dst <= src").groupBy("func").agg(F.count("*").alias("n"))


@query(f"WITH {_PROGRAMS} SELECT DISTINCT s.func, s.block AS src, s.block + 1 AS dst FROM n s LEFT JOIN n t ON t.func = s.func AND t.block = s.block + 1 WHERE t.block IS NULL")
def loose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the next number where there is no such block: the integrity check."""
    p = Programs(spark, sf_dir)
    return program.invalid_edges(p.blocks, p.blocks.select("func", F.col("block").alias("src"), (F.col("block") + 1).alias("dst")))


@query(f"""WITH RECURSIVE {_PROGRAMS}, skips AS (SELECT func, src, dst FROM e JOIN n USING (func) WHERE n.block = e.src AND (e.dst = n.skipped AND flag = 'R' OR e.dst = n.following AND flag <> 'R')),
    seen AS (SELECT DISTINCT func, first AS block FROM n UNION SELECT s.func, s.dst FROM seen JOIN skips s ON s.func = seen.func AND s.src = seen.block)
    SELECT func, block FROM n WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.func = n.func AND seen.block = n.block)""")
def unreachable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that nothing leads to from the first one where 'R' always skips."""
    p = Programs(spark, sf_dir)
    to = F.when(F.col("flag") == "R", F.col("skipped")).otherwise(F.col("following"))
    edges = p.blocks.select("func", F.col("block").alias("src"), to.alias("dst")).where("dst is not null")
    kinds = p.blocks.select("func", "block", F.when(F.col("block") == F.col("first"), "entry").otherwise("body").alias("block_type"))
    return program.unreachable_blocks(kinds, edges)


@query(f"WITH RECURSIVE {_PROGRAMS}, {_LIVE} SELECT func, block, fact AS variable FROM live")
def live_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that may be used after a block before they are set again."""
    return Programs(spark, sf_dir).live().withColumnRenamed("fact", "variable")


@query(f"WITH RECURSIVE {_PROGRAMS}, {_LIVE} SELECT func, block, def AS variable FROM b WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.func = b.func AND l.block = b.block AND l.fact = b.def)")
def dead_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a variable that nothing uses."""
    p = Programs(spark, sf_dir)
    return p.facts("def").join(p.live(), ["func", "block", "fact"], "left_anti").withColumnRenamed("fact", "variable")


@query(f"WITH RECURSIVE {_PROGRAMS}, {_REACHING} SELECT * FROM chains")
def def_use_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use with every setting that may reach it."""
    return Programs(spark, sf_dir).chains()


@query(f"WITH RECURSIVE {_PROGRAMS}, {_REACHING} SELECT func, block, use AS variable FROM b WHERE NOT EXISTS (SELECT 1 FROM chains c WHERE c.func = b.func AND c.use_block = b.block)")
def uninitialised_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses that no setting reaches: the functions' parameters."""
    p = Programs(spark, sf_dir)
    reached = p.chains().select("func", F.col("use_block").alias("block")).distinct()
    return p.blocks.select("func", "block", F.col("use").alias("variable")).join(reached, ["func", "block"], "left_anti")


@query(f"""WITH RECURSIVE {_PROGRAMS}, u AS (SELECT b.func, b.block, f.fact FROM b JOIN (SELECT DISTINCT func, use AS fact FROM b) f ON f.func = b.func),
    starts AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.func = u.func AND e.src = u.block)),
    gone AS (SELECT * FROM starts UNION SELECT e.func, e.src, b.def FROM e JOIN b ON b.func = e.func AND b.block = e.dst AND b.def <> b.use
        UNION SELECT e.func, e.src, g.fact FROM gone g JOIN b ON b.func = g.func AND b.block = g.block AND b.use <> g.fact JOIN e ON e.func = g.func AND e.dst = g.block)
    SELECT func, block, fact AS variable FROM u WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.func = u.func AND g.block = u.block AND g.fact = u.fact)""")
def very_busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every way on from a block's end uses before setting it: it may be computed there once."""
    p = Programs(spark, sf_dir)
    return dataflow.must_forward(dataflow.flipped(p.edges), p.facts("use"), p.facts("def"), p.blocks.select("func", "block")).withColumnRenamed("fact", "variable")


@query(f"""WITH RECURSIVE {_PROGRAMS}, gen AS (SELECT func, block, use AS fact FROM b WHERE use <> def), u AS (SELECT b.func, b.block, f.fact FROM b JOIN (SELECT DISTINCT func, fact FROM gen) f ON f.func = b.func),
    starts AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.func = u.func AND e.dst = u.block)),
    gone AS (SELECT * FROM starts UNION SELECT e.func, e.dst, b.def FROM e JOIN b ON b.func = e.func AND b.block = e.src
        UNION SELECT e.func, e.dst, g.fact FROM gone g JOIN e ON e.func = g.func AND e.src = g.block WHERE NOT EXISTS (SELECT 1 FROM gen WHERE gen.func = g.func AND gen.block = g.block AND gen.fact = g.fact))
    SELECT b.func, b.block, b.use AS variable FROM b JOIN u ON u.func = b.func AND u.block = b.block AND u.fact = b.use WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.func = b.func AND g.block = b.block AND g.fact = b.use)""")
def repeated_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses whose value every way to the block has computed already and nothing has changed since."""
    p = Programs(spark, sf_dir)
    gen = p.blocks.where("use <> def").select("func", "block", F.col("use").alias("fact"))
    held = dataflow.must_forward(p.edges, gen, p.facts("def"), p.blocks.select("func", "block"))
    return p.facts("use").join(held, ["func", "block", "fact"], "left_semi").withColumnRenamed("fact", "variable")


@query(f"""WITH RECURSIVE {_PROGRAMS}, {_REACHING}, s AS (SELECT DISTINCT n.func, n.last AS line, 0 AS d FROM n JOIN chains c ON c.func = n.func AND (c.def_block = n.last OR c.use_block = n.last)
        UNION SELECT c.func, c.def_block, d + 1 FROM s JOIN chains c ON c.func = s.func AND c.use_block = s.line WHERE d < 8)
    SELECT func, line, min(d) AS distance FROM s GROUP BY ALL""")
def backward_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each function's last block depends on by data, itself included."""
    p = Programs(spark, sf_dir)
    return program.slices(p.dependences(), p.lines("last"))


@query(f"""WITH RECURSIVE {_PROGRAMS}, {_REACHING}, s AS (SELECT DISTINCT n.func, n.first AS line, 0 AS d FROM n JOIN chains c ON c.func = n.func AND (c.def_block = n.first OR c.use_block = n.first)
        UNION SELECT c.func, c.use_block, d + 1 FROM s JOIN chains c ON c.func = s.func AND c.def_block = s.line WHERE d < 8)
    SELECT func, line, min(d) AS distance FROM s GROUP BY ALL""")
def forward_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each function's first block by data, itself included."""
    p = Programs(spark, sf_dir)
    return program.slices(p.dependences(), p.lines("first"), backward=False)


@query(f"""WITH RECURSIVE {_PROGRAMS}, {_REACHING}, c1 AS (SELECT * FROM chains WHERE variable = 'v1'),
    a AS (SELECT DISTINCT func, first AS line FROM n UNION SELECT c.func, c.use_block FROM a JOIN c1 c ON c.func = a.func AND c.def_block = a.line),
    z AS (SELECT DISTINCT func, last AS line FROM n UNION SELECT c.func, c.def_block FROM z JOIN c1 c ON c.func = z.func AND c.use_block = z.line)
    SELECT func, line FROM a INTERSECT SELECT func, line FROM z""")
def chops_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by which variable v1 carries the first block's effect to the last."""
    p = Programs(spark, sf_dir)
    return program.chops(p.dependences(), p.lines("first"), p.lines("last"), variable="v1")


@query(f"""WITH RECURSIVE {_PROGRAMS}, sets AS (SELECT func, block, def AS variable, value FROM b
        UNION ALL SELECT f.func, f.first, v.variable, NULL FROM (SELECT DISTINCT func, first FROM n) f JOIN (SELECT DISTINCT func, def AS variable FROM b) v ON v.func = f.func
            WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.func = f.func AND b.block = f.first AND b.def = v.variable)),
    rd AS (SELECT e.func, e.dst AS block, s.variable, s.block AS by FROM sets s JOIN e ON e.func = s.func AND e.src = s.block
        UNION SELECT e.func, e.dst, rd.variable, rd.by FROM rd JOIN e ON e.func = rd.func AND e.src = rd.block WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.func = rd.func AND s.block = rd.block AND s.variable = rd.variable))
    SELECT rd.func, rd.block, rd.variable, min(s.value) AS value FROM rd JOIN sets s ON s.func = rd.func AND s.block = rd.by AND s.variable = rd.variable GROUP BY ALL HAVING count(*) = count(s.value) AND min(s.value) = max(s.value)""")
def block_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that hold one same value on every way to a block."""
    return by_function.constants(Programs(spark, sf_dir).functions())


@query(f"""WITH RECURSIVE {_PROGRAMS}, ahead AS (SELECT func, src, dst, value FROM e JOIN n USING (func) WHERE n.block = e.src AND e.dst > e.src),
    w AS (SELECT DISTINCT func, first AS block, 0 AS v FROM n UNION SELECT a.func, a.dst, w.v + a.value FROM w JOIN ahead a ON a.func = w.func AND a.src = w.block)
    SELECT func, block, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high FROM w GROUP BY ALL""")
def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a counter that every block raises by its value, over all ways without loops."""
    p = Programs(spark, sf_dir)
    values = p.blocks.select("func", F.col("block").alias("src"), "value")
    none = F.lit(None).cast("double")
    edges = p.steps("following", "skipped").join(values, ["func", "src"]).select("func", "src", "dst", F.lit("x").alias("variable"), F.col("value").cast("double").alias("add"), none.alias("at_least"), none.alias("at_most"))
    starts = p.blocks.select("func", F.col("first").alias("block"), F.lit("x").alias("variable"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).distinct()
    return intervals.ranges(edges, starts, patience=8).select("func", "block", "low", "high")


@query(f"""WITH RECURSIVE {_PROGRAMS}, links AS (SELECT x.func, x.block AS a, y.block AS z FROM b x JOIN b y ON x.func = y.func AND x.block <> y.block AND (x.def IN (y.def, y.use) OR x.use IN (y.def, y.use))),
    r AS (SELECT func, block AS a, block AS z FROM b UNION SELECT r.func, r.a, links.z FROM r JOIN links ON links.func = r.func AND links.a = r.z)
    SELECT func, count(DISTINCT least_of)::BIGINT AS lcom3 FROM (SELECT func, a, min(z) AS least_of FROM r GROUP BY ALL) GROUP BY func""")
def lcom3_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into how many groups of blocks that share variables a function falls."""
    p = Programs(spark, sf_dir)
    uses = p.blocks.select(F.col("func").alias("owner"), F.col("block").alias("method"), F.explode(F.array("def", "use")).alias("attribute"))
    return measures.cohesion_groups(uses).select(F.col("owner").alias("func"), F.col("groups").alias("lcom3"))


def _graph(spark: SparkSession, sf_dir: str) -> traversal.Graph:
    """Blocks as nodes, control flow and data flow as two families of edges."""
    p = Programs(spark, sf_dir)
    name = lambda c: F.concat_ws(":", "func", c)
    nodes = p.blocks.select(name("block").alias("node"), F.when(F.col("flag") == "N", "use").otherwise("def").alias("kind"), F.col("flag").alias("name"), F.col("def").alias("var"), F.col("func").cast("string").alias("proc"))
    flow = p.edges.select(name("src").alias("src"), name("dst").alias("dst"), F.lit("cfg").alias("family"), F.lit("flow").alias("label"))
    data = p.blocks.where("def = use and following is not null").select(name("block").alias("src"), name("following").alias("dst"), F.lit("ddg").alias("family"), F.col("def").alias("label"))
    return traversal.Graph(nodes, flow.unionByName(data))


_GRAPH = f"""{_PROGRAMS}, nodes AS (SELECT func || ':' || block AS node, CASE WHEN flag = 'N' THEN 'use' ELSE 'def' END AS kind, flag AS name, def AS var FROM n),
    edges AS (SELECT func || ':' || src AS src, func || ':' || dst AS dst, 'cfg' AS family, 'flow' AS label FROM e UNION ALL SELECT func || ':' || block, func || ':' || following, 'ddg', def FROM n WHERE def = use AND following IS NOT NULL)"""


@query(f"WITH {_GRAPH} SELECT DISTINCT node FROM nodes WHERE kind = 'def' AND var = 'v1'")
def definitions_of_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal: the nodes that define v1."""
    g = _graph(spark, sf_dir)
    return traversal.definitions_of("v1")(g, g.nodes)


@query(f"WITH {_GRAPH} SELECT DISTINCT node FROM nodes WHERE kind = 'use' AND var = 'v2'")
def uses_of_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal: the nodes that use v2."""
    g = _graph(spark, sf_dir)
    return traversal.uses_of("v2")(g, g.nodes)


@query(f"""WITH {_GRAPH} SELECT DISTINCT y.dst AS node FROM nodes JOIN edges x ON x.src = node AND x.family = 'cfg' JOIN edges y ON y.src = x.dst AND y.family = 'ddg' WHERE name = 'R'
    EXCEPT SELECT src FROM edges WHERE label LIKE 'v3%'""")
def composed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal: from 'R' nodes one flow step, then one data step, less what is set from v3."""
    g = _graph(spark, sf_dir)
    steps = traversal.where("name = 'R'").then(traversal.out(traversal.family("cfg")), traversal.out(traversal.family("ddg")))
    v3 = traversal.EVERYTHING.then(traversal.out(traversal.prefix("v3")), traversal.into(traversal.prefix("v3")))
    return (steps - v3)(g, g.nodes)


@query(f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT DISTINCT node, 0 AS d FROM nodes WHERE name = 'A' UNION SELECT src, d + 1 FROM r JOIN edges ON dst = node AND family = 'ddg' WHERE d < 2)
    SELECT DISTINCT node FROM r EXCEPT SELECT node FROM nodes WHERE kind = 'use'""")
def traversed_to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal: what 'A' nodes depend on by data in at most two steps, without uses."""
    g = _graph(spark, sf_dir)
    back = traversal.where("name = 'A'").then(traversal.closure(traversal.family("ddg"), backward=True, depth=2))
    return (back & ~traversal.where("kind = 'use'"))(g, g.nodes)


@query(f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT node FROM nodes WHERE name = 'N' UNION SELECT dst FROM r JOIN edges ON src = node AND family IN ('ddg', 'cdg')) SELECT node FROM r""")
def dependence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traversal: everything that depends on 'N' nodes."""
    g = _graph(spark, sf_dir)
    return traversal.where("name = 'N'").then(traversal.dependence_slice(backward=False))(g, g.nodes)


@query(f"WITH {_GRAPH} SELECT 'unknown_dst' AS problem, count(*) AS n FROM edges WHERE dst NOT IN (SELECT node FROM nodes WHERE name <> 'R') HAVING count(*) > 0 UNION ALL SELECT 'unknown_src', count(*) FROM edges WHERE src NOT IN (SELECT node FROM nodes WHERE name <> 'R') HAVING count(*) > 0")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity report of a graph that lacks its 'R' nodes."""
    g = _graph(spark, sf_dir)
    return traversal.Graph(g.nodes.where("name <> 'R'"), g.edges).well_formed()


@query(f"""WITH {_PROGRAMS} SELECT func, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS value FROM (SELECT func, '    ' || src || CASE WHEN dst <= src THEN ' -->|back| ' ELSE ' --> ' END || dst AS line FROM e) GROUP BY func""")
def flow_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function's control flow as a Mermaid text."""
    edges = Programs(spark, sf_dir).edges.withColumn("label", F.when(F.col("dst") <= F.col("src"), "back"))
    return findings.mermaid(edges, "func")


@query(f"""WITH {_PROGRAMS} SELECT func, 'digraph {{' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}}' AS value FROM (SELECT func, '    "' || src || '" -> "' || dst || '";' AS line FROM e) GROUP BY func""")
def flow_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function's control flow as a DOT text."""
    return findings.dot(Programs(spark, sf_dir).edges, "func")


@query(f"""WITH {_PROGRAMS} SELECT '{{"ruleId":"LOOP","level":"' || CASE WHEN src - dst >= 3 THEN 'error' WHEN src - dst = 2 THEN 'warning' ELSE 'note' END || '","message":{{"text":"goes back"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || func || '"}},"region":{{"startLine":' || src || '}}}}}}]}}' AS value FROM e WHERE dst <= src""")
def sarif_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges back as SARIF results, one JSON text each."""
    back = Programs(spark, sf_dir).edges.where("dst <= src")
    return findings.sarif_results(back.select(F.lit("LOOP").alias("rule"), (F.col("src") - F.col("dst")).alias("severity"), F.lit("goes back").alias("message"), F.col("func").cast("string").alias("file"), F.col("src").alias("line")))


@query(f"""WITH {_PROGRAMS} SELECT func || ',' || block || ',' || def || ',' || use || ',"' || flag || '"' AS value FROM b""")
def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as lines of comma-separated values; the flag is quoted."""
    return Programs(spark, sf_dir).blocks.select(F.concat_ws(",", "func", "block", "def", "use", F.concat(F.lit('"'), "flag", F.lit('"'))).alias("value"))


_COSINE = "list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e))"


@query(f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query, v.vec_id AS id, round({_COSINE}, 6) AS similarity FROM q JOIN v ON q.vec_id <> v.vec_id AND v.label = 0)
    SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of label 0 most like each query (ids divisible by 100)."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = nearest.cosine_top_k(items.where("label = 0").select("id", "vector"), items.where("id % 100 = 0").select("id", "vector"), 5)
    return found.select("query", "id", "similarity", F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, round(list_sum(e), 5) AS total, sqrt(list_dot_product(e, e)) AS norm, list_dot_product(e, e) AS square FROM v)
    SELECT vec_id, total, round(square, 5) AS squared_norm, abs(norm - 1) < 0.001 AS is_normal, round(1 / (1 + norm), 5) AS score FROM s""")
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, squared length, whether of length one, and the score of the distance from the origin."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    square = add(F.transform(e, lambda x: x * x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(add(e), 5).alias("total"), F.round(square, 5).alias("squared_norm"), (F.abs(F.sqrt(square) - 1) < 0.001).alias("is_normal"), F.round(1 / (1 + F.sqrt(square)), 5).alias("score"))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS deviation, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag""")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of decimal values: equal values are counted before the exact quantiles are taken."""
    v = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"), *(F.round(F.percentile(v, q), 4).alias(n) for q, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99")))
    )


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS short, length(text) > 800 AS needs_chunking,
        regexp_matches(left(text, 1000), '(?i)(auto-generated|do not edit|generated by)') AS generated FROM d""")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 200 characters, whether they need cutting into chunks, and whether they say that they are generated."""
    text = F.coalesce("text", F.lit(""))
    short = F.when(F.char_length(text) <= 200, text).otherwise(F.concat(F.substring(text, 1, 200), F.lit("...")))
    return table(spark, sf_dir, "documents").select("doc_id", short.alias("short"), (F.char_length(text) > 800).alias("needs_chunking"), F.rlike(F.substring(text, 1, 1000), F.lit("(?i)(auto-generated|do not edit|generated by)")).alias("generated"))
