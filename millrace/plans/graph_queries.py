"""Graph queries over the star schema and over event transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import dataflow, graph
from millrace.operators.components import connected_components
from millrace.sources.tables import event_steps, node, star_edges, table

QUERIES, SQL = {}, {}

_EDGES = """edges AS (
    SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
    UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
    UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
_STEPS = """steps AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _kind(column: str = "node"):
    return F.substring(column, 1, 1)


@query(f"""WITH RECURSIVE {_EDGES},
    back(node, d) AS (SELECT 's' || min(s_suppkey), 0 FROM supplier UNION SELECT src, d + 1 FROM back JOIN edges ON dst = node)
    SELECT node[1] AS kind, distance, count(*) AS n FROM (SELECT node, min(d) AS distance FROM back GROUP BY node) GROUP BY ALL""")
def impact_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is affected if the first supplier changes: everything that reaches it, by kind and least distance."""
    target = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey").alias("k")).select(node("s", "k").alias("node"))
    return graph.reach(star_edges(spark, sf_dir), target, backward=True).groupBy(_kind().alias("kind"), "distance").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGES},
    ahead(node, d) AS (SELECT DISTINCT 'c' || c_custkey, 0 FROM customer WHERE c_nationkey = 0 UNION SELECT dst, d + 1 FROM ahead JOIN edges ON src = node WHERE d < 2)
    SELECT node, min(d) AS distance FROM ahead GROUP BY node HAVING min(d) > 0""")
def callees_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the customers of nation 0 reach in at most two steps, without themselves."""
    seeds = table(spark, sf_dir, "customer").where("c_nationkey = 0").select(node("c", "c_custkey").alias("node"))
    return graph.reach(star_edges(spark, sf_dir), seeds, max_depth=2).where("distance > 0")


@query(f"""WITH RECURSIVE {_EDGES},
    pairs(origin, node) AS (SELECT src, dst FROM edges WHERE src[1] = 's' UNION SELECT origin, dst FROM pairs JOIN edges ON src = node)
    SELECT origin, node FROM pairs""")
def reach_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node that each supplier reaches."""
    edges = star_edges(spark, sf_dir)
    return graph.reach_pairs(edges, edges.where(_kind("src") == "s").select(F.col("src").alias("node")))


@query(f"""WITH {_EDGES},
    d AS (SELECT node, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)
    SELECT node[1] AS kind, CASE WHEN fan_in = 0 THEN 'entry' WHEN fan_out = 0 THEN 'leaf' ELSE 'middle' END AS role,
        count(*) AS n, max(fan_in)::BIGINT AS most_in, max(fan_out)::BIGINT AS most_out FROM d GROUP BY ALL""")
def arch_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry, middle and leaf nodes by kind, with the largest degrees."""
    found = graph.roles(star_edges(spark, sf_dir))
    return found.groupBy(_kind().alias("kind"), "role").agg(F.count("*").alias("n"), F.max("fan_in").cast("long").alias("most_in"), F.max("fan_out").cast("long").alias("most_out"))


@query(f"""WITH RECURSIVE {_EDGES},
    walk(node, d) AS (SELECT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, d + 1 FROM walk JOIN edges ON src = node)
    SELECT node[1] AS kind, layer, count(*) AS n FROM (SELECT node, max(d) AS layer FROM walk GROUP BY node) GROUP BY ALL""")
def arch_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind and layer, a layer being the longest distance from an entry."""
    return graph.layers(star_edges(spark, sf_dir)).groupBy(_kind().alias("kind"), "layer").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGES},
    walk(node) AS (SELECT src FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst FROM walk JOIN edges ON src = node)
    SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, count(*) AS ordered, count(*) = (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS acyclic FROM walk""")
def is_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a topological order takes in all nodes."""
    edges = star_edges(spark, sf_dir)
    marked = graph.nodes_of(edges).select(F.lit(0).alias("placed")).unionByName(graph.layers(edges).select(F.lit(1).alias("placed")))
    counts = marked.agg(F.count_if(F.col("placed") == 0).alias("nodes"), F.count_if(F.col("placed") == 1).alias("ordered"))
    return counts.withColumn("acyclic", F.col("nodes") == F.col("ordered"))


@query(f"""WITH RECURSIVE {_STEPS}, edges AS (SELECT DISTINCT event_type AS src, next_type AS dst FROM steps WHERE next_type IS NOT NULL),
    r(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM r JOIN edges ON src = b),
    n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
    SELECT node, coalesce((SELECT max(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node), node) AS component FROM n""")
def scc_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the graph of event types that follow each other."""
    steps = event_steps(spark, sf_dir).where("next_type is not null")
    return graph.strong_components(steps.select(F.col("event_type").alias("src"), F.col("next_type").alias("dst")).distinct())


@query(f"""WITH RECURSIVE {_EDGES},
    f(node) AS (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 5 UNION SELECT src FROM f JOIN edges ON dst = node),
    b(node) AS (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst FROM b JOIN edges ON src = node)
    SELECT node FROM (SELECT node FROM f INTERSECT SELECT node FROM b)""")
def chop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that lies between customers of one segment and the first five nations."""
    sources = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(node("c", "c_custkey").alias("node"))
    targets = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(node("n", "n_nationkey").alias("node"))
    return graph.chop(star_edges(spark, sf_dir), sources, targets)


@query(f"""WITH RECURSIVE {_EDGES}, san AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'),
    clean AS (SELECT * FROM edges WHERE src NOT IN (SELECT node FROM san) AND dst NOT IN (SELECT node FROM san)),
    t(node) AS (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT dst FROM t JOIN clean ON src = node)
    SELECT 's' || s_suppkey AS node FROM supplier WHERE 's' || s_suppkey IN (SELECT node FROM t)""")
def taint_reaches_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers reached from customers in debt through orders that are neither urgent nor pending."""
    sources = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(node("c", "c_custkey").alias("node"))
    sinks = table(spark, sf_dir, "supplier").select(node("s", "s_suppkey").alias("node"))
    checks = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' or o_orderstatus = 'P'").select(node("o", "o_orderkey").alias("node"))
    return graph.unsanitized(star_edges(spark, sf_dir), sources, sinks, checks)


@query("""SELECT p_partkey, CASE WHEN l_partkey IS NULL THEN 'never_called' ELSE 'live' END AS reason, coalesce(n, 0) AS uses
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the number of their uses, and those that nothing uses."""
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    joined = table(spark, sf_dir, "part").join(uses, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.when(F.col("uses").isNull(), "never_called").otherwise("live").alias("reason"), F.coalesce("uses", F.lit(0)).alias("uses"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_nationkey + 1000000 AS b FROM supplier UNION SELECT s_nationkey + 1000000, s_suppkey FROM supplier),
    l(node, root) AS (SELECT a, a FROM e UNION SELECT b, root FROM l JOIN e ON a = node WHERE root < b)
    SELECT node::BIGINT AS node, min(root)::BIGINT AS root FROM l GROUP BY node""")
def supplier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations by connected component."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1000000).cast("long").alias("b"))
    return connected_components(s)


@query(f"""WITH {_STEPS} SELECT event_type, next_type, count(*) AS n, count(DISTINCT user_id) AS users FROM steps WHERE next_type IS NOT NULL GROUP BY ALL""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between event types, how often and by how many users."""
    return event_steps(spark, sf_dir).where("next_type is not null").groupBy("event_type", "next_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH b AS (SELECT user_id, event_type, event_id, row_number() OVER w AS k, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS killed_by FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    ends AS (SELECT user_id, max(k) AS last_k FROM b GROUP BY user_id)
    SELECT b.user_id, b.event_type, b.event_id FROM b WHERE killed_by IS NULL""")
def reaching_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that reach the end of a user's events: the last of each type, the earlier ones being killed."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("killed_by", F.lead("event_id").over(w)).where("killed_by is null").select("user_id", "event_type", "event_id")


@query(f"""WITH RECURSIVE {_EDGES}, blocks AS (SELECT * FROM edges WHERE src[1] IN ('s', 'n')),
    held(block, fact) AS (SELECT dst, src FROM blocks WHERE src[1] = 's' UNION SELECT dst, fact FROM held JOIN blocks ON src = block)
    SELECT block, count(*) AS facts FROM held GROUP BY block""")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as definitions, carried along to nations and regions: how many reach each block's entry."""
    edges = star_edges(spark, sf_dir).where(_kind("src").isin("s", "n")).withColumn("func", F.lit("star"))
    gen = edges.where(_kind("src") == "s").select("func", F.col("src").alias("block"), F.col("src").alias("fact"))
    held = dataflow.may_forward(edges, gen, gen.limit(0))
    return held.groupBy("block").agg(F.count("*").alias("facts"))


@query(f"""WITH RECURSIVE {_EDGES}, blocks AS (SELECT * FROM edges WHERE src[1] IN ('s', 'n')),
    gen AS (SELECT DISTINCT 's' || s_suppkey AS block, CASE WHEN s_acctbal >= 0 THEN 'solvent' ELSE 'overdrawn' END AS fact FROM supplier),
    nation_in AS (SELECT dst AS block, fact FROM blocks JOIN gen ON src = block GROUP BY dst, fact HAVING count(*) = (SELECT count(*) FROM blocks b WHERE b.dst = blocks.dst)),
    region_in AS (SELECT dst AS block, fact FROM blocks JOIN nation_in ON src = block GROUP BY dst, fact HAVING count(*) = (SELECT count(*) FROM blocks b WHERE b.dst = blocks.dst))
    SELECT block, fact FROM nation_in UNION ALL SELECT block, fact FROM region_in""")
def available_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds at a nation or region for all suppliers under it (a must-analysis)."""
    edges = star_edges(spark, sf_dir).where(_kind("src").isin("s", "n")).withColumn("func", F.lit("star"))
    fact = F.when(F.col("s_acctbal") >= 0, "solvent").otherwise("overdrawn")
    gen = table(spark, sf_dir, "supplier").select(F.lit("star").alias("func"), node("s", "s_suppkey").alias("block"), fact.alias("fact"))
    blocks = graph.nodes_of(edges).select(F.lit("star").alias("func"), F.col("node").alias("block"))
    return dataflow.must_forward(edges, gen, gen.limit(0), blocks).select("block", "fact")
