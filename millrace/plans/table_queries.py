"""Queries over tables: metrics, coupling, joins, sets, vectors, events, deltas, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as vx
from millrace.lineage import stored
from millrace.operators import components, incremental, measures, nearest
from millrace.sources.tables import table
from millrace.streaming import windows

QUERIES, SQL = {}, {}
_LINES_OF = "per AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY l_orderkey)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity::BIGINT)::BIGINT AS total, round(avg(l_quantity::BIGINT), 6) AS mean, min(l_quantity::BIGINT) AS least, max(l_quantity::BIGINT) AS most,
    floor(quantile_cont(l_quantity::BIGINT, 0.5))::BIGINT AS median FROM lineitem GROUP BY ALL""")
def complexity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of quantities by flag and status."""
    lines = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return measures.integer_stats(lines, "q", "l_returnflag", "l_linestatus")


@query(f"""WITH {_LINES_OF} SELECT CASE WHEN quantity <= 10 THEN 'low' WHEN quantity <= 20 THEN 'medium' WHEN quantity <= 50 THEN 'high' ELSE 'critical' END AS band, count(*) AS orders FROM per GROUP BY band""")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the band of their quantity."""
    return _per_order(spark, sf_dir).groupBy(measures.risk_band(F.col("quantity")).alias("band")).agg(F.count("*").alias("orders"))


@query(f"""WITH {_LINES_OF}, b AS (SELECT least(floor((quantity - 1) / 20)::BIGINT, 14) AS bucket, count(*) AS n FROM per GROUP BY 1)
    SELECT i AS bucket, coalesce(n, 0) AS n FROM generate_series(0, 14) g(i) LEFT JOIN b ON b.bucket = i""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by quantity in fifteen buckets of 20, the last open."""
    return measures.histogram(_per_order(spark, sf_dir), "quantity", 20, 15)


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS u FROM lineitem), c AS (SELECT m, count(*) AS ce FROM u GROUP BY m), p AS (SELECT u, count(*) AS used_by FROM u GROUP BY u)
    SELECT u.m AS l_suppkey, any_value(ce) AS ce, sum(CASE WHEN used_by > 1 THEN 1 ELSE 0 END)::BIGINT AS shared, round(any_value(ce) / (any_value(ce) + sum(CASE WHEN used_by > 1 THEN 1 ELSE 0 END)), 6) AS instability
    FROM u JOIN c ON c.m = u.m JOIN p ON p.u = u.u GROUP BY u.m""")
def coupling_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each supplier, those that others use too, and the instability of both."""
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("m"), F.col("l_partkey").alias("u")).distinct()
    shared = uses.groupBy("u").agg((F.count("*") > 1).cast("long").alias("s"))
    out = uses.join(shared, "u").groupBy(F.col("m").alias("l_suppkey")).agg(F.count("*").alias("ce"), F.sum("s").alias("shared"))
    return out.withColumn("instability", F.round(F.col("ce") / (F.col("ce") + F.col("shared")), 6))


@query("""WITH e AS (SELECT DISTINCT n_regionkey AS a, s_nationkey AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT DISTINCT s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    ce AS (SELECT a AS module, count(*) AS ce FROM e GROUP BY a), ca AS (SELECT b AS module, count(*) AS ca FROM e GROUP BY b)
    SELECT coalesce(ce.module, ca.module) AS module, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, round(coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(ca, 0)), 6) AS instability FROM ce FULL JOIN ca ON ce.module = ca.module""")
def coupling_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Afferent and efferent coupling between numbers of nations and regions."""
    pairs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_nationkey")
    uses = pairs.select(F.col("n_regionkey").alias("module"), F.col("s_nationkey").alias("uses"))
    return measures.coupling(uses.unionByName(uses.select(F.col("uses").alias("module"), F.col("module").alias("uses"))))


@query("""WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS owner, user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY ALL),
    p AS (SELECT x.owner, count_if(len(list_intersect(x.a, y.a)) = 0) AS p, count_if(len(list_intersect(x.a, y.a)) > 0) AS q FROM s x JOIN s y ON y.owner = x.owner AND x.user_id < y.user_id GROUP BY x.owner)
    SELECT owner, (SELECT count(*) FROM s WHERE s.owner = p.owner) AS methods, greatest(0, p - q) AS lcom1, p - q AS lcom2 FROM p""")
def lcom_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lack of cohesion of each day: users as methods, event types as attributes."""
    uses = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("owner"), F.col("user_id").alias("method"), F.col("event_type").alias("attribute"))
    return measures.lack_of_cohesion(uses).where("methods > 1")


@query("""SELECT l_suppkey, lines, parts, orders, lines_over + parts_over AS score, CASE WHEN lines_over + parts_over >= 50 THEN 'critical' WHEN lines_over + parts_over >= 10 THEN 'high' ELSE 'low' END AS severity FROM (
    SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, greatest(0, count(*) - 500) AS lines_over, 2 * greatest(0, count(DISTINCT l_partkey) - 400) AS parts_over FROM lineitem GROUP BY l_suppkey)""")
def god_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by weighted excess over thresholds."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))
    score = F.greatest(F.lit(0), F.col("lines") - 500) + 2 * F.greatest(F.lit(0), F.col("parts") - 400)
    return t.withColumn("score", score).withColumn("severity", F.when(score >= 50, "critical").when(score >= 10, "high").otherwise("low"))


@query("""SELECT lang, count(*) AS labelled, sum(toxic)::BIGINT AS toxic, sum(quality)::BIGINT AS good, concat_ws(',', CASE WHEN sum(toxic) * 10 > count(*) THEN 'toxic' END, CASE WHEN sum(quality) * 2 < count(*) THEN 'quality' END) AS reasons,
    sum(toxic) * 10 <= count(*) AND sum(quality) * 2 >= count(*) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages whose labelled texts pass the gates, and why others do not."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    t = joined.groupBy("lang").agg(F.count("*").alias("labelled"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("good"))
    bad, poor = F.col("toxic") * 10 > F.col("labelled"), F.col("good") * 2 < F.col("labelled")
    return t.select("*", F.concat_ws(",", F.when(bad, "toxic"), F.when(poor, "quality")).alias("reasons"), (~bad & ~poor).alias("passed"))


@query("""WITH c AS (SELECT c_custkey, s_suppkey, CASE WHEN s_nationkey = c_nationkey THEN 100 ELSE 50 END + CASE WHEN s_acctbal > 5000 THEN 25 ELSE 0 END AS score
        FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey)
    SELECT c_custkey, s_suppkey, score FROM c QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1""")
def resolve_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supplier for each customer: same nation before same region, then balance, then key. Candidates are ranked once per nation."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").select("n_nationkey", "n_regionkey")
    region_of = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "s_acctbal", "n_regionkey")
    score = F.when(F.col("s_nationkey") == F.col("n_nationkey"), 100).otherwise(50) + F.when(F.col("s_acctbal") > 5000, 25).otherwise(0)
    best = nations.join(region_of, "n_regionkey").groupBy("n_nationkey").agg(F.max_by(F.struct("s_suppkey", score.alias("score")), F.struct(score, -F.col("s_suppkey"))).alias("best"))
    return t("customer").join(best, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "best.s_suppkey", "best.score")


@query("""WITH w AS (SELECT e.user_id, e.event_id AS span, ts AS a, ts + INTERVAL 6 HOUR AS b FROM events e WHERE event_type = 'signup')
    SELECT span, count(e.event_id) AS inside FROM w LEFT JOIN events e ON e.user_id = w.user_id AND e.ts >= a AND e.ts < b AND e.event_type <> 'signup' GROUP BY span""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the six hours from each signup of a user: an equi-join on user and six-hour cell, then the interval."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    span = 6 * 3600 * 1_000_000
    starts = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span"), F.col("at").alias("a"))
    cell = F.floor(F.col("a") / span)
    celled = starts.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    others = events.where("event_type != 'signup'").select("user_id", "event_id", "at", F.floor(F.col("at") / span).alias("cell"))
    met = celled.join(others, ["user_id", "cell"]).where((F.col("at") >= F.col("a")) & (F.col("at") < F.col("a") + span)).groupBy("span").agg(F.count("*").alias("n"))
    return starts.join(met, "span", "left").select("span", F.coalesce("n", F.lit(0)).alias("inside"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS in_either,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS in_both,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS only_urgent,
    (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS complement""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and complement of customers with urgent and with finished orders, from one grouping."""
    flags = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("u"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("f"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(flags, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    u, f = F.coalesce("u", F.lit(0)) == 1, F.coalesce("f", F.lit(0)) == 1
    return joined.agg(F.count_if(u | f).alias("in_either"), F.count_if(u & f).alias("in_both"), F.count_if(u & ~f).alias("only_urgent"), F.count_if(F.col("c_custkey").isNotNull() & ~f).alias("complement"))


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events)
    SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY ALL""")
def interference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event types live on one day of one user."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    pairs = F.flatten(F.transform("kinds", lambda x: F.transform(F.filter("kinds", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return d.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, min(ts) AS first_def, max(ts) AS last_use, count(*) AS n FROM events GROUP BY ALL""")
def live_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last event of each type of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_def"), F.max("ts").alias("last_use"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count_if(event_type = 'signup') AS acquired, count_if(event_type = 'signup' AND before = 'signup') AS double_acquire, count_if(event_type = 'error' AND coalesce(before, 'error') = 'error') AS double_release,
        count_if(event_type = 'signup' AND after IS NULL) AS leaked FROM s GROUP BY user_id""")
def resource_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typestate of each user: signup acquires, error releases; double and missing steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").where("event_type in ('signup', 'error')").withColumns({"before": F.lag("event_type").over(w), "after": F.lead("event_type").over(w)})
    take, give = F.col("event_type") == "signup", F.col("event_type") == "error"
    return s.groupBy("user_id").agg(
        F.count_if(take).alias("acquired"),
        F.count_if(take & (F.col("before") == "signup")).alias("double_acquire"),
        F.count_if(give & (F.coalesce("before", F.lit("error")) == "error")).alias("double_release"),
        F.count_if(take & F.col("after").isNull()).alias("leaked"),
    )


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'deleted' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id""")
def classify_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users between two half months by their number of events."""
    events = table(spark, sf_dir, "events")
    half = lambda sign: events.where(f"ts {sign} timestamp'2024-01-16'").groupBy("user_id").agg(F.count("*").alias("n"))
    return incremental.classify(half("<"), half(">="), "user_id", "n")


@query("""SELECT user_id, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE event_type <> 'error' OR ts >= TIMESTAMP '2024-01-20' GROUP BY ALL""")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept current: a first state, additions since, then the removal of old errors."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(1).alias("sign"))
    keys = ["user_id", "event_type"]
    first = events.where("ts < timestamp'2024-01-10'").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    grown = incremental.merged_counts(first, events.where("ts >= timestamp'2024-01-10'"), keys, "cents")
    gone = events.where("event_type = 'error' and ts < timestamp'2024-01-20'").withColumn("sign", F.lit(-1))
    return incremental.merged_counts(grown, gone, keys, "cents")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type from the events as a stream."""
    events = windows.event_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return windows.run_to_end(events, "1 day").select("start", "event_type", "n", "cents")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(CASE WHEN list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e) = 0 THEN 0 ELSE list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)) END, 6) AS similarity FROM q JOIN v ON q.vec_id <> v.vec_id)
    SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like each query (ids divisible by 100), exactly."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.cosine_top_k(items, items.where("id % 100 = 0"), 10).select("query", "id", "similarity", F.col("rank").cast("long").alias("rank"))


_NEAR = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT e, min(vec_id) AS representative FROM v GROUP BY e), m AS (SELECT v.vec_id, r.representative FROM v JOIN r ON r.e = v.e),
    p AS (SELECT x.representative AS a, y.representative AS b, round(list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)), 6) AS similarity FROM r x JOIN r y ON x.representative < y.representative
        WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.4)"""


def _similar(spark: SparkSession, sf_dir: str) -> nearest.SimilarPairs:
    return nearest.SimilarPairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.4)


@query(f"WITH {_NEAR} SELECT a, b, similarity FROM p")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different vectors with a cosine of 0.4 or more."""
    return _similar(spark, sf_dir).pairs()


@query(f"""WITH RECURSIVE {_NEAR}, links AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS node, a AS root FROM links UNION SELECT links.b, c.root FROM c JOIN links ON links.a = c.node)
    SELECT m.vec_id, m.representative, (SELECT count(*) FROM links WHERE links.a = m.representative) AS links, coalesce((SELECT min(c.root) FROM c WHERE c.node = m.representative), m.representative) AS cluster FROM m""")
def similar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the class of those equal to it, the class's links, and the cluster that links lead to."""
    near = _similar(spark, sf_dir)
    links = stored(near.pairs())
    counts = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    roots = components.connected_components(links).withColumnsRenamed({"node": "representative", "root": "cluster"})
    joined = near.members().join(counts, "representative", "left").join(roots, "representative", "left")
    return joined.select(F.col("id").alias("vec_id"), "representative", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("cluster", "representative").alias("cluster"))


@query("""WITH p AS (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL) SELECT label, pos, round(m, 6) AS mean FROM p""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each coordinate by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH p AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT e.label, list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(c, c)) AS s FROM embeddings e JOIN p ON e.label = p.label)
    SELECT label, count(*) AS n, round(avg(s), 5) AS mean, round(min(s), 5) AS least, round(max(s), 5) AS most FROM s GROUP BY label""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of vectors to their label's centroid."""
    e = table(spark, sf_dir, "embeddings").select("label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    s = e.join(centres, "label").select("label", vx.cosine("embedding", "c").alias("s"))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 5).alias("mean"), F.round(F.min("s"), 5).alias("least"), F.round(F.max("s"), 5).alias("most"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
    s AS (SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, CASE WHEN f IS NOT NULL THEN list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)) END AS s FROM v)
    SELECT vec_id, norm, round(s, 5) AS similarity, CASE WHEN s IS NULL THEN NULL WHEN s >= 0.98 THEN 'duplicate' WHEN s >= 0.90 THEN 'very_similar' WHEN s >= 0.80 THEN 'similar' ELSE 'low' END AS class FROM s""")
def similarity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's length and its likeness to the next of its label, as a class."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(w))
    s = v.select("vec_id", F.round(vx.norm("embedding"), 5).alias("norm"), F.when(F.col("next").isNotNull(), vx.cosine("embedding", "next")).alias("s"))
    return s.select("vec_id", "norm", F.round("s", 5).alias("similarity"), F.when(F.col("s").isNotNull(), vx.similarity_class(F.col("s"))).alias("class"))


@query("""SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL ORDER BY total DESC LIMIT 25""")
def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 strongest pairs of segment and nation: orders are summed by customer before the joins."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    joined = sums.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = joined.groupBy("c_mktsegment", "n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))
    return out.orderBy(F.col("total").desc(), "c_mktsegment", "n_name").limit(25)
