"""Each query applies an operator to a stand-in table; ORACLE has the same in DuckDB's SQL.

Stand-ins: an order is a mail (thread: customer, date: order date, subject: priority); an order's suppliers by line are
its persons, the first of them the sender; embeddings' labels are clusters, label 0 being noise; documents are bodies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..functions.vectors import centroids, cosine
from ..operators import graph, persons, reports, search, segments, topics
from ..operators.bm25 import Index, bm25, word_scores
from ..operators.components import shared_path
from ..sources.mailbox import new_rows, pending, upsert_watermark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TERMS, QUERY_ID, NOISE = ("the", "and", "ening"), 0, 0
AS_OF = "1998-08-02"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def mails(spark: SparkSession, d: str) -> DataFrame:
    """(id, thread, day, sender, recipients)."""
    lines = tab(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("sender"), F.collect_set("l_suppkey").alias("everyone"))
    o = tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread"), day("o_orderdate").alias("day"))
    return o.join(lines, "id").select("id", "thread", "day", "sender", F.array_remove("everyone", F.col("sender")).alias("recipients"))


MAILS = """m AS (SELECT o_orderkey AS id, o_custkey AS thread, strftime(o_orderdate, '%Y-%m-%d') AS day, sender FROM orders
  JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS sender FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
r AS (SELECT DISTINCT m.id, m.day, l_suppkey AS person FROM m JOIN lineitem ON l_orderkey = m.id WHERE l_suppkey != m.sender)"""
PERSONS = f"""{MAILS}, x AS (SELECT sender AS person, 1 AS s, day FROM m UNION ALL SELECT person, 0, day FROM r),
p AS (SELECT person, count(*) AS email_count, sum(s)::BIGINT AS as_sender, sum(1 - s)::BIGINT AS as_recipient, min(day) AS first_date, max(day) AS last_date FROM x GROUP BY 1)"""


def _persons(spark, d):
    return persons.person_stats(mails(spark, d), "sender", "recipients", "day")


@query(f"WITH {PERSONS} SELECT *, date_diff('day', last_date::DATE, DATE '{AS_OF}') <= 60 AS active FROM p")
def person_stats(spark, d):
    return _persons(spark, d).withColumn("active", F.datediff(F.lit(AS_OF).cast("date"), F.to_date("last_date")) <= 60)


@query(f"WITH {PERSONS}, k AS (SELECT *, row_number() OVER (ORDER BY email_count DESC, person) AS n FROM p) SELECT person, email_count, n <= 3 AS main_contact FROM k")
def main_contacts(spark, d):
    return persons.main_contacts(_persons(spark, d)).select("person", "email_count", "main_contact")


@query(f"""WITH {MAILS}, a AS (SELECT DISTINCT l_orderkey AS id, s_suppkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT id, n_name, string_agg(s_suppkey::VARCHAR, ', ' ORDER BY s_suppkey::VARCHAR) AS who FROM a GROUP BY 1, 2)
SELECT id, string_agg(n_name || ': ' || who, ' | ' ORDER BY n_name || ': ' || who) AS participants FROM b GROUP BY 1""")
def participants_by_firm(spark, d):
    firms = tab(spark, d, "supplier").join(tab(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    people = tab(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("s_suppkey")).join(firms, "s_suppkey")
    return persons.firms_of(people, "id", "s_suppkey", "n_name")


@query("""WITH s AS (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) GROUP BY 1)
SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS n_seeds FROM lineitem SEMI JOIN s USING (l_suppkey) GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2""")
def seed_overlap(spark, d):
    lines = tab(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    top = tab(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("l_orderkey"))
    seeds = lines.join(top, "l_orderkey", "left_semi").agg(F.collect_set("l_suppkey").alias("seeds"))
    each = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("people"))
    return each.crossJoin(F.broadcast(seeds)).select("id", F.size(F.array_intersect("people", "seeds")).cast("long").alias("n_seeds")).where("n_seeds >= 2")


# ---- scans, counts, sizes


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority LIKE '1%' ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 500")
def pending_scan(spark, d):
    o = tab(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return o.orderBy(F.col("o_orderdate").asc_nulls_first(), "o_orderkey").limit(500).select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("day"))


@query("SELECT count(*) AS n, count(*) FILTER (text IS NOT NULL AND text != '') AS with_body, count(*) FILTER (n_chars > 1000) AS long_bodies, count(DISTINCT source) AS sources FROM documents")
def counts_snapshot(spark, d):
    return tab(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNotNull() & (F.col("text") != "")).alias("with_body"), F.count_if(F.col("n_chars") > 1000).alias("long_bodies"), F.count_distinct("source").alias("sources"))


@query("SELECT lang, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1")
def folder_stats(spark, d):
    return tab(spark, d, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""WITH w AS (SELECT *, strftime(max(o_orderdate) OVER () - INTERVAL 30 DAY, '%Y-%m-%d') AS start FROM orders)
SELECT o_custkey AS conversation_id, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(*) FILTER (strftime(o_orderdate, '%Y-%m-%d') >= start) AS n_window FROM w GROUP BY 1 HAVING n_window > 0""")
def window_conversations(spark, d):
    o = tab(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("day"))
    start = o.agg(F.date_format(F.date_sub(F.to_date(F.max("day")), 30), "yyyy-MM-dd").alias("start"))
    return o.crossJoin(F.broadcast(start)).groupBy(F.col("o_custkey").alias("conversation_id")).agg(F.max("day").alias("last"), F.count_if(F.col("day") >= F.col("start")).alias("n_window")).where("n_window > 0")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '20+' END AS bucket, count(*) AS groups, sum(n)::BIGINT AS mails, max(n) AS largest FROM g GROUP BY 1""")
def size_distribution(spark, d):
    g = tab(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise("20+")
    return g.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("groups"), F.sum("n").alias("mails"), F.max("n").alias("largest"))


@query("SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def histogram_of_counts(spark, d):
    return tab(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


@query("SELECT o_custkey AS thread, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%URGENT%' GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, thread LIMIT 1")
def largest_thread(spark, d):
    o = tab(spark, d, "orders").where(F.col("o_orderpriority").contains("URGENT"))
    return o.groupBy(F.col("o_custkey").alias("thread")).agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "thread").limit(1)


@query("""WITH g AS (SELECT o_orderkey, o_custkey AS tid, o_custkey * 12 + month(o_orderdate) AS cid FROM orders)
SELECT count(*) AS groups, sum(n)::BIGINT AS mails FROM (SELECT tid, count(DISTINCT cid) AS c, count(*) AS n FROM g GROUP BY 1) WHERE c > 1""")
def split_counts(spark, d):
    g = tab(spark, d, "orders").select(F.col("o_custkey").alias("tid"), (F.col("o_custkey") * 12 + F.month("o_orderdate")).alias("cid"))
    return g.groupBy("tid").agg(F.count_distinct("cid").alias("c"), F.count("*").alias("n")).where("c > 1").agg(F.count("*").alias("groups"), F.sum("n").alias("mails"))


@query("SELECT label AS cluster, count(*) AS size, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM embeddings GROUP BY 1")
def cluster_sizes(spark, d):
    g = tab(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    return g.withColumn("percent", F.round(100.0 * F.col("size") / F.sum("size").over(Window.partitionBy()), 1))


@query("""SELECT count(*) AS n, median(q) AS median, round(avg(q), 4) AS mean, min(q) AS low, max(q) AS high, round(stddev_pop(q), 4) AS deviation,
round(quantile_cont(q, 0.1), 4) AS p10, round(quantile_cont(q, 0.9), 4) AS p90, count(*) FILTER (d = 0) AS zeros FROM (SELECT l_quantity AS q, l_discount AS d FROM lineitem)""")
def distribution_stats(spark, d):
    q = F.col("l_quantity")
    return tab(spark, d, "lineitem").agg(
        F.count("*").alias("n"), F.median(q).alias("median"), F.round(F.avg(q), 4).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.stddev_pop(q), 4).alias("deviation"),
        F.round(F.percentile(q, 0.1), 4).alias("p10"), F.round(F.percentile(q, 0.9), 4).alias("p90"), F.count_if(F.col("l_discount") == 0).alias("zeros"),
    )


@query("""WITH g AS (SELECT c_mktsegment AS folder, count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(n)::BIGINT, sum(missing)::BIGINT FROM g""")
def missing_per_folder(spark, d):
    both = tab(spark, d, "customer").join(tab(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    g = both.groupBy(F.col("c_mktsegment").alias("folder")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"))
    return g.unionByName(g.agg(F.sum("n").alias("n"), F.sum("missing").alias("missing")).withColumn("folder", F.lit("TOTAL")))


# ---- writes


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS slice FROM orders")
def dedup_append(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("day"))
    old = o.where("id % 3 = 0").withColumn("slice", F.lit("old"))
    batch = o.unionByName(o.where("id % 2 = 0")).withColumn("slice", F.lit("new"))
    return old.unionByName(new_rows(batch, old, "id", "day"))


@query("SELECT o_orderpriority AS folder, max(o_orderkey) AS last_uid FROM orders GROUP BY 1")
def watermark_upsert(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.col("o_orderkey").alias("last_uid"))
    top = o.groupBy("folder").agg(F.max("last_uid").alias("last_uid"))
    return upsert_watermark(top, o.where("last_uid % 2 = 0"), "folder", "last_uid")


# ---- time


def _orders(spark, d):
    return tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("thread"), F.col("o_orderdate").alias("ts"))


BLOCKS = """b AS (SELECT o_orderkey AS id, o_custkey AS thread, o_orderdate AS ts, date_sub('day', lag(o_orderdate) OVER w, o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)),
c AS (SELECT *, sum(CASE WHEN gap > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts NULLS FIRST, id)::BIGINT AS block FROM b)"""


@query(f"WITH {BLOCKS} SELECT id, thread, block FROM c")
def time_blocks(spark, d):
    return segments.time_blocks(_orders(spark, d), "thread", "ts", "id", 90).select("id", "thread", "block")


@query(f"WITH {BLOCKS} SELECT id, thread, block FROM c QUALIFY block = max(block) OVER (PARTITION BY thread)")
def latest_block(spark, d):
    return segments.latest_block(segments.time_blocks(_orders(spark, d), "thread", "ts", "id", 90), "thread").select("id", "thread", "block")


@query("""WITH b AS (SELECT o_orderkey AS id, o_custkey AS thread, o_orderdate AS ts, date_sub('day', o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)) AS gap FROM orders),
c AS (SELECT *, sum(CASE WHEN gap > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ts DESC NULLS LAST, id DESC) AS cuts FROM b) SELECT id, thread FROM c WHERE cuts = 0""")
def active_streak(spark, d):
    return segments.active_streak(_orders(spark, d), "thread", "ts", "id", 180).select("id", "thread")


@query("""WITH b AS (SELECT event_id, user_id, ts, date_sub('hour', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id))
SELECT event_id, user_id, sum(CASE WHEN gap > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)::BIGINT AS block FROM b""")
def event_blocks(spark, d):
    return segments.time_blocks(tab(spark, d, "events"), "user_id", "ts", "event_id", 24, "hour").select("event_id", "user_id", "block")


@query("""WITH b AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS before, date_sub('day', lag(o_orderdate) OVER w, o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey))
SELECT id, before FROM b WHERE gap <= 60""")
def adjacent_gap_guard(spark, d):
    from ..functions.dates import whole_days

    w = Window.partitionBy("thread").orderBy(F.col("ts").asc_nulls_first(), "id")
    o = _orders(spark, d).select("id", F.lag("id").over(w).alias("before"), whole_days(F.lag("ts").over(w), F.col("ts")).alias("gap"))
    return o.where("gap <= 60").select("id", "before")


@query("SELECT o_custkey AS thread, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def newest_per_thread(spark, d):
    return segments.newest(_orders(spark, d), "thread", "ts", "id").select("thread", "id")


@query("""WITH g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM g WHERE n <= 3 OR i <= 1 OR i > n - 1 OR (i > n // 2 AND i <= n // 2 + 1)""")
def sample_first_mid_last(spark, d):
    return segments.sample_thirds(tab(spark, d, "conversations"), "conv_id", [F.col("turn")], 1).select("conv_id", "turn")


@query("SELECT o_orderpriority AS folder, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 10")
def topn_per_cluster(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return segments.top_n(o, ["folder"], [F.desc("o_totalprice"), F.col("id")], 10, "rank").select("folder", "id", "rank")


@query("""WITH e AS (SELECT o_custkey AS thread, strftime(min(o_orderdate), '%Y-%m-%d') AS d_from, strftime(min(o_orderdate) + INTERVAL 365 DAY, '%Y-%m-%d') AS d_to FROM orders GROUP BY 1)
SELECT thread, count(*) AS n FROM orders JOIN e ON thread = o_custkey AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN d_from AND d_to GROUP BY 1""")
def episode_assignment(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_custkey").alias("thread"), day("o_orderdate").alias("day"))
    first = o.groupBy("thread").agg(F.min("day").alias("d_from"))
    e = first.withColumn("d_to", F.date_format(F.date_add(F.to_date("d_from"), 365), "yyyy-MM-dd"))
    return segments.in_episodes(o, e, "thread", "day").groupBy("thread").agg(F.count("*").alias("n"))


@query(f"""WITH {BLOCKS}, e AS (SELECT thread, block, min(ts) - INTERVAL 60 DAY AS a, max(ts) + INTERVAL 60 DAY AS b FROM c GROUP BY 1, 2)
SELECT x.thread, x.block AS first, y.block AS second FROM e x JOIN e y ON x.thread = y.thread AND x.block < y.block AND x.a <= y.b AND y.a <= x.b""")
def episode_overlaps(spark, d):
    blocks = segments.time_blocks(_orders(spark, d), "thread", "ts", "id", 90).groupBy("thread", "block").agg((F.min("ts") - F.expr("INTERVAL 60 DAYS")).alias("d_from"), (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("d_to"))
    return segments.overlapping(blocks, "thread", "block")


# ---- vectors


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
COS = f"{DOT} / ({NORM.format('{0}')} * {NORM.format('{1}')})"
Q = f"q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_ID})"
CENTROIDS = """e AS (SELECT label AS cluster, u.i, avg(u.x::DOUBLE) AS m FROM (SELECT label, unnest(list_zip(range(len(embedding)), embedding)) AS z FROM embeddings), LATERAL (SELECT z[1] AS i, z[2] AS x) u GROUP BY 1, 2),
c0 AS (SELECT cluster, list(m ORDER BY i) AS v FROM e GROUP BY 1), c AS (SELECT cluster, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c0)"""


def _vectors(spark, d):
    return tab(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") != NOISE, F.col("label")).alias("cluster"), F.col("embedding").alias("vector"))


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in tab(spark, d, "embeddings").where(f"vec_id = {QUERY_ID}").first()["embedding"]]


@query(f"WITH {CENTROIDS} SELECT cluster, u.i::INT AS i, round(u.x, 4) AS x FROM (SELECT cluster, unnest(list_zip(range(len(v)), v)) AS z FROM c), LATERAL (SELECT z[1] AS i, z[2] AS x) u")
def cluster_centroids(spark, d):
    c = centroids(tab(spark, d, "embeddings").withColumnRenamed("label", "cluster"), "cluster", "embedding")
    return c.select("cluster", F.posexplode("centroid").alias("i", "x")).select("cluster", "i", F.round("x", 4).alias("x"))


@query(f"WITH {Q} SELECT vec_id AS id, round(greatest(0, {COS.format('embedding', 'q')}), 4) AS similarity FROM embeddings, q ORDER BY {COS.format('embedding', 'q')} DESC, vec_id LIMIT 100")
def vector_topk(spark, d):
    return topics.vector_top_k(_vectors(spark, d), "id", "vector", query_vector(spark, d)).select("id", F.round("similarity", 4).alias("similarity"))


CLUSTER_SCORES = f"""{CENTROIDS}, {Q}, near AS (SELECT cluster, {COS.format('v', 'q')} AS s FROM c, q WHERE cluster != {NOISE}), k AS (SELECT cluster, s, row_number() OVER (ORDER BY s DESC, cluster) AS r FROM near QUALIFY r <= 3),
cs AS (SELECT vec_id AS id, CASE WHEN label = {NOISE} THEN -0.1 ELSE greatest(0, s) * [1.0, 0.7, 0.5][r] END AS score FROM embeddings LEFT JOIN k ON label = cluster WHERE label = {NOISE} OR s IS NOT NULL)"""


@query(f"WITH {CLUSTER_SCORES} SELECT id, round(score, 4) AS score FROM cs")
def cluster_signal(spark, d):
    return topics.cluster_scores(_vectors(spark, d), query_vector(spark, d)).select("id", F.round("score", 4).alias("score"))


TOPICS = f"""{CENTROIDS}, s AS (SELECT vec_id AS id, cluster, {COS.format('embedding', 'v')} AS s FROM embeddings, c),
t AS (SELECT *, s >= avg(s) OVER p + 2 * stddev_pop(s) OVER p AS ok, row_number() OVER (PARTITION BY id ORDER BY s DESC, cluster) AS r FROM s WINDOW p AS (PARTITION BY id)),
tt AS (SELECT id, cluster, round(s, 4) AS similarity, r::INT AS rank, CASE WHEN bool_or(ok) OVER (PARTITION BY id) THEN 0 ELSE 1 END AS low_confidence, ok FROM t QUALIFY ok OR (r = 1 AND NOT bool_or(ok) OVER (PARTITION BY id)))"""


def _topics(spark, d):
    e = tab(spark, d, "embeddings")
    return topics.topics(e, "vec_id", "embedding", centroids(e.withColumnRenamed("label", "cluster"), "cluster", "embedding"))


@query(f"WITH {TOPICS} SELECT id, cluster::BIGINT AS cluster, similarity, rank, low_confidence FROM tt")
def multi_topics(spark, d):
    return _topics(spark, d).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {TOPICS} SELECT n AS topics, count(*) AS mails, count(*) FILTER (low = 1) AS low FROM (SELECT id, count(*) AS n, max(low_confidence) AS low FROM tt GROUP BY 1) GROUP BY 1")
def topics_histogram(spark, d):
    g = _topics(spark, d).groupBy("id").agg(F.count("*").alias("topics"), F.max("low_confidence").alias("l"))
    return g.groupBy("topics").agg(F.count("*").alias("mails"), F.count_if(F.col("l") == 1).alias("low"))


SAMPLE = """a AS (SELECT vec_id, label, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) <= 10)"""


@query(f"""WITH {SAMPLE}, p AS (SELECT x.label = y.label AS same, {COS.format('x.v', 'y.v')} AS s FROM a x JOIN a y ON x.vec_id < y.vec_id)
SELECT same, count(*) AS n, round(min(s), 4) AS low, round(avg(s), 4) AS mean, round(max(s), 4) AS high, round(stddev_pop(s), 4) AS deviation FROM p GROUP BY 1""")
def pairwise_stats(spark, d):
    p = _sampled_pairs(spark, d)
    return p.groupBy("same").agg(F.count("*").alias("n"), F.round(F.min("s"), 4).alias("low"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.max("s"), 4).alias("high"), F.round(F.stddev_pop("s"), 4).alias("deviation"))


def _sampled_pairs(spark, d):
    """Ten of each cluster by a seeded hash: the feature is a model comparison on a stratified sample."""
    s = segments.seeded_sample(tab(spark, d, "embeddings"), ["label"], "vec_id", 10).select("vec_id", "label", F.col("embedding").alias("v"))
    x, y = s.alias("x"), s.alias("y")
    return x.join(y, F.col("x.vec_id") < F.col("y.vec_id")).select((F.col("x.label") == F.col("y.label")).alias("same"), cosine(F.col("x.v"), F.col("y.v")).alias("s"))


@query()
def density_clusters(spark, d):
    return topics.density_clusters(tab(spark, d, "embeddings"), "vec_id", "embedding", 0.5, 5)


# ---- words


FOLDED = f"translate(lower(coalesce(text, '')), '{T.ACCENTED}', '{T.PLAIN}')"
_HAVE = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in TERMS]
BM25 = f"""w AS (SELECT doc_id AS id, regexp_extract_all({FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
f AS (SELECT id, len(t) AS len, {', '.join(f'{h} AS f{i}' for i, h in enumerate(_HAVE))} FROM w),
g AS (SELECT count(*) AS n, avg(len) AS mean, {', '.join(f'count(*) FILTER (f{i} > 0) AS d{i}' for i in range(len(TERMS)))} FROM f),
bm AS (SELECT id, -({' + '.join(f'(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))' for i in range(len(TERMS)))}) AS rank
 FROM f, g WHERE {' OR '.join(f'f{i} > 0' for i in range(len(TERMS)))}),
ws0 AS (SELECT * FROM bm ORDER BY rank, id LIMIT 300), ws AS (SELECT id, CASE WHEN min(rank) OVER () = max(rank) OVER () THEN 1.0 ELSE 0.7 + 0.3 * (rank - max(rank) OVER ()) / (min(rank) OVER () - max(rank) OVER ()) END AS score FROM ws0)"""


@query(f"WITH {BM25} SELECT id, round(rank, 6) AS rank FROM bm")
def bm25_search(spark, d):
    return bm25(tab(spark, d, "documents"), "doc_id", ["text"], list(TERMS)).select("id", F.round("rank", 6).alias("rank"))


_indexes: dict[tuple, Index] = {}


def index_of(spark, d) -> Index:
    """The documents' postings index, built at the first use in a session, and again when the files change."""
    docs = tab(spark, d, "documents")
    key = (spark.sparkContext.applicationId, *docs.inputFiles())
    if key not in _indexes:
        _indexes[key] = Index.build(docs, "doc_id", ["text"], shared_path(spark, "index"))
    return _indexes[key]


@query(f"WITH {BM25} SELECT id, round(rank, 6) AS rank FROM bm")
def bm25_index(spark, d):
    return index_of(spark, d).ranks(list(TERMS)).select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {BM25} SELECT count(*) AS hits FROM bm")
def word_hits(spark, d):
    return index_of(spark, d).hit_count(list(TERMS))


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM ws")
def word_search(spark, d):
    return word_scores(bm25(tab(spark, d, "documents"), "doc_id", ["text"], list(TERMS))).select("id", F.round("score", 6).alias("score"))


HYBRID = f"""{BM25}, {CLUSTER_SCORES}, vs AS (SELECT vec_id AS id, greatest(0, {COS.format('embedding', 'q')}) AS score FROM embeddings, q ORDER BY {COS.format('embedding', 'q')} DESC, vec_id LIMIT 100),
un AS (SELECT id, 0.3 * score AS s FROM ws UNION ALL SELECT id, 0.5 * score FROM vs UNION ALL SELECT id, 0.2 * score FROM cs),
h AS (SELECT id, sum(s) AS score FROM un GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50), hits AS (SELECT id, round(score, 4) AS score FROM h WHERE round(score, 4) >= 0.2)"""
SEARCH = EngineConfig(top_k=50, min_score=0.2)


def _hits(spark, d):
    docs = tab(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.hybrid_search(docs, _vectors(spark, d), list(TERMS), query_vector(spark, d), SEARCH, ("text",), index_of(spark, d))


@query(f"WITH {HYBRID} SELECT id, score FROM hits")
def hybrid_search(spark, d):
    return _hits(spark, d).select("id", F.round("score", 4).alias("score"))


@query(f"""WITH {HYBRID}, m AS (SELECT doc_id AS id, lang || source AS thread FROM documents), t AS (SELECT DISTINCT thread FROM m SEMI JOIN hits USING (id))
SELECT id, thread, id NOT IN (SELECT id FROM hits) AS expanded FROM m WHERE thread IN (SELECT thread FROM t)""")
def thread_expand(spark, d):
    m = tab(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", "source").alias("thread"))
    return search.expand_threads(_hits(spark, d), m, "id", "thread")


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word NOT IN ('that', 'this') GROUP BY 1 ORDER BY n DESC, word LIMIT 12""")
def top_words(spark, d):
    w = tab(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1))).alias("word"))
    return w.where(~F.col("word").isin("that", "this")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(12)


def _share(letters: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{letters}]', '', 'g'))) / length(text)"


@query(f"""SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 15 THEN 'other' WHEN {_share(T.LETTERS_SK_ONLY)} > 0 THEN 'sk' WHEN {_share(T.LETTERS_SK)} > 0.015 THEN 'sk'
WHEN {_share(T.LETTERS_DE)} > 0.01 THEN 'de' WHEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) > 0.96 THEN 'en' ELSE 'other' END AS language FROM documents""")
def detect_language(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.detect_language(F.col("text")).alias("language"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')) AS text FROM a""")
def html_strip(spark, d):
    return tab(spark, d, "pages").select("page_id", T.html_strip(F.col("html")).alias("text"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace('Re: FW: ' || p_name || '  x', '(?i)^((?:Re|Fwd|FW|Odp|VS|AW)\\s*[:\\s]\\s*)+', ''))), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS subject FROM part""")
def normalize_subjects(spark, d):
    return tab(spark, d, "part").select("p_partkey", T.normalize_subject(F.concat(F.lit("Re: FW: "), "p_name", F.lit("  x"))).alias("subject"))


@query("SELECT doc_id, length(trim(split_part(coalesce(text, ''), chr(10), 1))) > 0 AS has_head, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents")
def body_lines(spark, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return tab(spark, d, "documents").select("doc_id", (F.length(F.trim(lines[0])) > 0).alias("has_head"), F.size(lines).cast("long").alias("n_lines"))


_CUT = ", ".join(f"CASE WHEN regexp_matches(x, '(?i){c}') THEN strpos(x, regexp_extract(x, '(?i){c}')) END" for c in T.QUOTE_CUTS)


@query(rf"""WITH b AS (SELECT doc_id, coalesce(text, '') || [chr(10) || 'On Mon, Jun 1, 2026 at 10:41 you wrote' || chr(10) || '> q', chr(10) || '> quoted' || chr(10) || 'From: a' || chr(10) || chr(10) || chr(10) || 'more' || chr(10) || 'Best regards' || chr(10) || 'me', chr(10) || '--' || chr(10) || 'sig', ' end'][doc_id % 4 + 1] AS x FROM documents),
c AS (SELECT doc_id, CASE WHEN least({_CUT}) IS NULL THEN x ELSE substr(x, 1, least({_CUT}) - 1) END AS x FROM b),
l AS (SELECT doc_id, string_split(x, chr(10)) AS lines FROM c),
e AS (SELECT doc_id, lines, list_position(list_transform(lines, lambda s: regexp_matches(trim(s), '(?i)^{T.SIGNATURES}') OR trim(s) IN ('--', '—')), true) AS k FROM l),
k AS (SELECT doc_id, CASE WHEN k > 0 THEN lines[1:k - 1] ELSE lines END AS lines FROM e),
g AS (SELECT doc_id, list_filter(lines, lambda s: NOT (starts_with(trim(s), '>') OR regexp_matches(trim(s), '(?i)^{T.FORWARD_HEADERS}') OR regexp_matches(trim(s), '(?i)^{T.FORWARD_SEPARATORS}'))) AS lines FROM k)
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM g""")
def clean_body(spark, d):
    tails = ["\nOn Mon, Jun 1, 2026 at 10:41 you wrote\n> q", "\n> quoted\nFrom: a\n\n\nmore\nBest regards\nme", "\n--\nsig", " end"]
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % 4 + 1).cast("int")))
    return tab(spark, d, "documents").select("doc_id", T.clean_body(text).alias("body"))


MAIL_TYPES = """t AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN 'No-Reply@x.example' WHEN o_custkey % 10 = 1 THEN NULL ELSE 'a@x.example' END AS sender,
CASE o_orderpriority[1] WHEN '1' THEN 'Meeting minutes: ' || o_orderkey WHEN '2' THEN 'Beach PARTY ' || o_orderkey WHEN '3' THEN 'weekly  report' WHEN '4' THEN 'partying' END AS subject FROM orders)"""


@query(f"""WITH {MAIL_TYPES} SELECT id, CASE WHEN regexp_matches(lower(coalesce(sender, '')), '(?i){T.BULK_SENDERS}') OR regexp_matches(coalesce(subject, ''), '(?i){T.BULK_SUBJECTS}') THEN 'BULK'
WHEN regexp_matches(coalesce(subject, ''), '(?i){T.SOCIAL_SUBJECTS}') THEN 'SOCIAL' ELSE 'WORK' END AS type FROM t""")
def classify_priority(spark, d):
    c, p, k = F.col("o_custkey") % 10, F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string")
    sender = F.when(c == 0, "No-Reply@x.example").when(c != 1, "a@x.example")
    subject = F.when(p == "1", F.concat(F.lit("Meeting minutes: "), k)).when(p == "2", F.concat(F.lit("Beach PARTY "), k)).when(p == "3", "weekly  report").when(p == "4", "partying")
    return tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.email_type(sender, subject).alias("type"))


@query("""WITH v AS (SELECT o_custkey AS conversation_id, CASE WHEN o_orderpriority ILIKE '%urgent%' THEN 'alpha' WHEN o_orderpriority ILIKE '%medium%' THEN 'beta' END AS project FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)),
n AS (SELECT conversation_id, min(project) AS project FROM v GROUP BY 1) SELECT conversation_id, coalesce(project, 'unknown') AS project, CASE WHEN project IS NULL THEN 'unknown' ELSE 'name' END AS project_source FROM n""")
def project_id_rules(spark, d):
    from ..operators.conversations import project_of

    s = tab(spark, d, "orders").select(F.col("o_custkey").alias("conversation_id"), F.col("o_orderpriority").alias("subject"))
    labels = s.select("conversation_id").distinct().withColumn("label", F.lit(None).cast("string"))
    return project_of(s, labels, EngineConfig(name_rules=(("urgent", "alpha"), ("medium", "beta")), code_rules=(("ZZ1", "gamma"),), cluster_rules=(("none", "delta"),)))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%thing%' OR source ILIKE 'SRC1%'")
def keyword_groups(spark, d):
    return tab(spark, d, "documents").where(F.col("text").ilike("%thing%") | F.col("source").ilike("SRC1%")).select("doc_id")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE NOT (lang = 'en' OR source = 'src1')")
def keyword_exclusion(spark, d):
    return tab(spark, d, "documents").where(~((F.col("lang") == "en") | (F.col("source") == "src1"))).join(tab(spark, d, "labels"), "doc_id").select("doc_id", "quality")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    return tab(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_name WHEN 3 THEN p_brand ELSE p_name END[:80] AS label, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN '' WHEN 3 THEN '' ELSE '' END[:200] AS description FROM part""")
def label_json(spark, d):
    from ..functions.parsing import label_and_description

    quoted = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    forms = [
        quoted('{"description": "', t, '", "label": " ', n, ' "}'), quoted('Sure! {"title": "', n, '", "nazov": "', t, '", "opis": "', b, '", "desc": "no"} done'), quoted("\n  ", n, "\n", t),
        quoted('x {"label": "', b, '", "a": {"b": 1}} y'), quoted('{"name": "', n, '"}'),
    ]
    k, raw = F.col("p_partkey") % 5, F.lit(None)
    for i, f in enumerate(forms):
        raw = F.when(k == i, f).otherwise(raw)
    return tab(spark, d, "part").select("p_partkey", label_and_description(raw).alias("x")).select("p_partkey", "x.*")


@query("""WITH a AS (SELECT o_orderkey AS id, list_distinct(list_transform(list(l_suppkey), lambda k: CASE WHEN k % 7 = 0 THEN 'noreply' || k || '@x.example' WHEN k % 7 = 1 THEN 'nowhere' ELSE 's' || k || '@x.example' END)) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT id, array_to_string(list_sort(list_filter(p, lambda x: contains(x, '@') AND NOT starts_with(x, 'noreply'))), ',') AS persons FROM a""")
def persons_of_mail(spark, d):
    k = F.col("l_suppkey").cast("string")
    address = F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("NoReply"), k, F.lit("@x.example"))).when(F.col("l_suppkey") % 7 == 1, "nowhere").otherwise(F.concat(F.lit(" S"), k, F.lit("@x.example")))
    entry = F.struct(F.lit("n").alias("name"), address.alias("address"))
    m = tab(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(entry).alias("to"), F.first(address).alias("sender"))
    m = m.join(tab(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id")
    return m.select("id", F.array_join(T.persons_of_mail(F.col("sender"), F.col("to")), ",").alias("persons"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')[:300]), '[\\p{L}\\p{N}_]{2,}')[1:12], ' ') AS terms FROM documents""")
def query_terms(spark, d):
    return tab(spark, d, "documents").select("doc_id", F.array_join(T.query_terms(F.substring(F.coalesce("text", F.lit("")), 1, 300)), " ").alias("terms"))


@query("""SELECT p_partkey, trim(p_name) || ' ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_type END AS input FROM part""")
def embedding_inputs(spark, d):
    return tab(spark, d, "part").select("p_partkey", T.embedding_input(F.concat(F.lit("  "), "p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_type"))).alias("input"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE i <= 2 OR i > n - 2")
def sample_first_last(spark, d):
    return segments.sample_halves(tab(spark, d, "conversations"), "conv_id", [F.col("turn")], 2).select("conv_id", "turn")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%d-%b-%Y') AS day, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 60 AS active FROM orders")
def search_dates(spark, d):
    from ..functions.dates import imap_date, is_active

    return tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), imap_date(F.col("o_orderdate")).alias("day"), is_active(F.col("o_orderdate"), F.lit(AS_OF).cast("date")).alias("active"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'F ' || s_suppkey ELSE 'folder' || s_suppkey END AS folder FROM supplier WHERE s_suppkey % 5 != 0""")
def folder_lines(spark, d):
    from ..sources.mailbox import folders

    k = F.col("s_suppkey").cast("string")
    flags = F.when(F.col("s_suppkey") % 5 == 0, "(\\Noselect)").otherwise("(\\HasNoChildren)")
    line = F.concat(flags, F.lit(' "/" '), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('"F '), k, F.lit('"'))).otherwise(F.concat(F.lit("folder"), k)))
    out = folders(tab(spark, d, "supplier").select(line.alias("line")))
    return out.select(F.regexp_extract("folder", r"(\d+)$", 1).cast("long").alias("s_suppkey"), "folder")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS total, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS n_addresses FROM orders""")
def tolerant_json(spark, d):
    from ..functions.parsing import fenced_json

    k = F.col("o_custkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "no json at all").otherwise(F.concat(F.lit("```json\nhere {\"total\": "), k, F.lit(", \"deep\": {\"a\": 1}} end\n```")))
    people = F.when(F.col("o_orderkey") % 4 == 0, "[broken").otherwise('[{"name": "n", "address": "a@x.example"}, {"name": "", "address": "b@x.example"}]')
    return tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fenced_json(raw, "total double")["total"].alias("total"), F.size(T.address_list(people)).alias("n_addresses"))


@query("""WITH x AS (SELECT conv_id, string_agg(CASE WHEN length(text) > 100 THEN text[:100] || ' […]' ELSE text END, chr(10) || '---' || chr(10) ORDER BY turn) AS t, count(*)::INT AS n FROM conversations GROUP BY 1)
SELECT conv_id, n, CASE WHEN length(t) > 600 THEN t[:600] || ' […]' ELSE t END AS thread FROM x""")
def thread_text(spark, d):
    from ..models import thread_text as build

    return build(tab(spark, d, "conversations"), "conv_id", ["turn"], "text", 100, 600)


@query("SELECT item_id, count(*) AS n FROM benchmark JOIN documents d ON contains(lower(d.text), lower(benchmark.text)) GROUP BY 1")
def fact_presence(spark, d):
    return reports.fact_counts(tab(spark, d, "documents"), "text", tab(spark, d, "benchmark"), "item_id", "text")


# ---- graph


PAIRS = """e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem), em AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM e x JOIN e y ON x.k = y.k AND x.p < y.p GROUP BY 1, 2),
t AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey), th AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM t x JOIN t y ON x.k = y.k AND x.p < y.p GROUP BY 1, 2)"""
EDGES = f"""{PAIRS}, w AS (SELECT a, b, sum(w)::DOUBLE AS w FROM (SELECT a, b, 3 * n AS w FROM th UNION ALL SELECT a, b, n FROM em) GROUP BY 1, 2), i AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8),
ed0 AS (SELECT a, b, CASE WHEN a IN (FROM i) AND b IN (FROM i) THEN w * 0.2 ELSE w END AS weight FROM w), ed AS (SELECT * FROM ed0 WHERE weight >= 2)"""


def _edges(spark, d):
    lines = tab(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    threads = lines.join(tab(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    internal = tab(spark, d, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("person"))
    persons_of = lambda df, key: df.select(F.col(key).alias("k"), F.col("l_suppkey").alias("p"))
    return graph.edge_weights(persons_of(threads, "o_custkey"), persons_of(lines, "l_orderkey"), internal)


@query(f"WITH {PAIRS} SELECT * FROM em")
def pair_cooccurrence(spark, d):
    return graph.pairs(tab(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"WITH {EDGES} SELECT a, b, round(weight, 4) AS weight FROM ed")
def edge_weights(spark, d):
    return _edges(spark, d).withColumn("weight", F.round("weight", 4))


DEGREES = f"{EDGES}, dg AS (SELECT node, count(*) AS degree, sum(weight) AS ww FROM (SELECT a AS node, weight FROM ed UNION ALL SELECT b, weight FROM ed) GROUP BY 1), ce AS (SELECT *, degree / (count(*) OVER () - 1) AS c FROM dg)"


@query(f"WITH {DEGREES} SELECT node, degree, round(ww, 4) AS weighted_degree, round(c, 6) AS centrality FROM ce")
def degree_centrality(spark, d):
    return graph.degrees(_edges(spark, d)).select("node", "degree", F.round("weighted_degree", 4).alias("weighted_degree"), F.round("centrality", 6).alias("centrality"))


@query(f"WITH {DEGREES}, hub AS (SELECT node FROM ce ORDER BY c DESC, node LIMIT 5) SELECT a, b, round(weight, 4) AS weight FROM ed WHERE a NOT IN (FROM hub) AND b NOT IN (FROM hub)")
def hub_prune(spark, d):
    return graph.prune_hubs(_edges(spark, d), 5).withColumn("weight", F.round("weight", 4))


@query()
def communities(spark, d):
    return graph.communities(graph.prune_hubs(_edges(spark, d), 5))


@query("""WITH RECURSIVE e0 AS (SELECT x.o_custkey AS a, y.o_custkey AS b FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1 WHERE x.o_orderkey % 10 < 3 AND x.o_custkey != y.o_custkey),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r AS (SELECT DISTINCT o_custkey AS node, o_custkey AS root FROM orders UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
SELECT node, min(root) AS component FROM r GROUP BY 1""")
def connected_components(spark, d):
    from ..operators.components import connected_components as solve

    o = tab(spark, d, "orders").select("o_orderkey", "o_custkey")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("b"))
    edges = o.join(nxt, "o_orderkey").where("o_orderkey % 10 < 3 AND o_custkey != b").select(F.col("o_custkey").alias("a"), "b")
    return solve(o.select(F.col("o_custkey").alias("node")).distinct(), edges)


def stand_in_mails(spark, d) -> DataFrame:
    """documents and orders as full mail rows, for the composite queries."""
    o = mails(spark, d).join(tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderdate"), "id")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"), F.lit("@example.com"))
    reply = F.lag("id").over(Window.partitionBy("thread").orderBy("o_orderdate", "id"))
    mid = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit("@x>"))
    return o.select(
        "id", mid(F.col("id")).alias("message_id"), F.when(F.col("id") % 2 == 0, mid(reply)).alias("in_reply_to"), F.lit(None).cast("string").alias("references"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), name(F.col("sender")).alias("from_address"),
        F.array_join(F.transform("recipients", name), ",").alias("to_addresses"), F.lit("").alias("cc_addresses"), F.concat(F.lit("Re: "), "o_orderpriority", F.lit(" "), (F.col("thread") % 97).cast("string")).alias("subject"), "thread",
    )


@query()
def stitch_conversations(spark, d):
    from ..operators.conversations import conversations

    return conversations(stand_in_mails(spark, d))[0]


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS c, date_trunc('second', o_orderdate) AS ts, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date, 'Re: ' || o_orderpriority || ' ' || (o_custkey % 97) AS subject FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
w AS (SELECT c, count(*) FILTER (date >= (SELECT strftime(max(ts)::DATE - INTERVAL 30 DAY, '%Y-%m-%d') FROM m)) AS n_window FROM m GROUP BY 1),
g AS (SELECT *, date_sub('day', ts, lag(ts) OVER (PARTITION BY c ORDER BY ts DESC, id DESC)) > 21 AS cut FROM m),
s AS (SELECT * FROM (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY ts DESC, id DESC) AS cuts FROM g) WHERE cuts = 0),
b AS (SELECT *, sum(CASE WHEN older THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY ts, id) AS block FROM (SELECT *, date_sub('day', lag(ts) OVER (PARTITION BY c ORDER BY ts, id), ts) > 6 AS older FROM s)),
z AS (SELECT c, count(*) AS n_streak, count(*) FILTER (block = top) > 20 AS needs_topic FROM (SELECT *, max(block) OVER (PARTITION BY c) AS top FROM b) GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c ORDER BY ts DESC, id DESC) = 1)
SELECT c AS conversation_id, subject, date AS last_activity, n_window::BIGINT AS n_window, n_streak, needs_topic FROM l JOIN w USING (c) JOIN z USING (c) WHERE n_window > 0 ORDER BY date DESC, c LIMIT 25""")
def active_window(spark, d):
    from ..operators.conversations import active_window as run

    return run(stand_in_mails(spark, d).withColumn("conversation_id", F.col("thread")))


@query(f"""WITH {MAILS}, h AS (SELECT m.*, o_orderdate AS ts FROM m JOIN orders ON o_orderkey = id ORDER BY strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), id LIMIT 5),
lim AS (SELECT strftime(min(ts)::DATE - INTERVAL 90 DAY, '%Y-%m-%dT00:00:00Z') AS low, strftime(max(ts)::DATE + INTERVAL 90 DAY, '%Y-%m-%dT00:00:00Z') AS high FROM h),
ce0 AS (SELECT i, avg(x::DOUBLE) AS x FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings JOIN h ON id = vec_id) GROUP BY 1), ce AS (SELECT list(x ORDER BY i) AS v FROM ce0),
pp AS (SELECT id, sender AS person FROM m UNION SELECT id, person FROM r), ov AS (SELECT id FROM pp WHERE person IN (SELECT sender FROM h) GROUP BY 1 HAVING count(*) >= 2)
SELECT m.id, round(score, 4) AS score FROM (SELECT m.*, CASE WHEN embedding IS NOT NULL AND v IS NOT NULL THEN {COS.format('embedding', 'v')} END AS score FROM m LEFT JOIN embeddings ON vec_id = id, ce) m JOIN ov USING (id) JOIN orders ON o_orderkey = m.id, lim
WHERE sender IN (SELECT sender FROM h) AND m.id NOT IN (SELECT id FROM h) AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') BETWEEN low AND high AND (score IS NULL OR score > 0)""")
def person_expansion(spark, d):
    m = stand_in_mails(spark, d).withColumn("to_addresses", F.split("to_addresses", ",")).join(_vectors(spark, d).select("id", "vector"), "id", "left")
    hits = m.orderBy("date", "id").limit(5).select("id")
    return search.expand_persons(hits, hits, m, EngineConfig(context_threshold=0.0)).withColumn("score", F.round("score", 4))


@query("SELECT doc_id, NULL::VARCHAR AS language FROM documents WHERE doc_id % 2 != 0 OR lang IS NULL ORDER BY doc_id LIMIT 500")
def pending_bodies(spark, d):
    m = tab(spark, d, "documents").withColumn("language", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return pending(m.select("doc_id", "language"), "language", "doc_id", 500)


@query("SELECT p_brand AS sender, count(*) AS n, sum(p_size)::BIGINT AS size FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_name ILIKE '%a%') GROUP BY 1 ORDER BY n DESC, sender LIMIT 20")
def sender_counts_in_clusters(spark, d):
    p = tab(spark, d, "part")
    inside = p.where(F.col("p_name").ilike("%a%")).select("p_type").distinct()
    return p.join(inside, "p_type", "left_semi").groupBy(F.col("p_brand").alias("sender")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).orderBy(F.desc("n"), "sender").limit(20)


@query("SELECT c_nationkey AS conversation_id, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) = 1")
def dominant_label(spark, d):
    g = tab(spark, d, "customer").groupBy(F.col("c_nationkey").alias("conversation_id"), F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    return segments.top_n(g, ["conversation_id"], [F.desc("n"), F.col("label")], 1)


# ---- flows


def _text_mails(spark, d) -> DataFrame:
    """documents as mails: thread by language and source, date by number, sender by number, text as body."""
    n = F.col("doc_id")
    return tab(spark, d, "documents").select(
        n.alias("id"), F.concat_ws("-", "lang", "source", (n % 40).cast("string")).alias("thread_id"), F.concat(F.lit("subject "), (n % 40).cast("string")).alias("subject"), F.concat(F.lit("p"), (n % 3).cast("string"), F.lit("@x.example")).alias("from_address"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("date"), F.col("text").alias("body_text"), F.substring("text", 1, 20).alias("body_snippet"), F.lit("").alias("to_addresses"),
    )


TEXT_MAILS = """tm AS (SELECT doc_id AS id, concat_ws('-', lang, source, doc_id % 40) AS thread_id, 'subject ' || doc_id % 40 AS subject, 'p' || doc_id % 3 || '@x.example' AS sender, strftime(DATE '2024-01-01' + (doc_id % 300)::INT, '%Y-%m-%d') AS day, text FROM documents),
th AS (SELECT thread_id, count(*)::INT AS n, arg_min(subject, (day, id)) AS subject, min(day) AS date_from, max(day) AS date_to, list_sort(list_distinct(list(sender))) AS who FROM tm WHERE text IS NOT NULL AND text != '' GROUP BY 1)"""


@query(f"WITH {TEXT_MAILS} SELECT thread_id, n, subject, date_from, date_to, array_to_string(who, ',') AS senders FROM th WHERE n >= 3")
def thread_list(spark, d):
    from ..operators import flows

    t = flows.threads(_text_mails(spark, d))
    return t.select("thread_id", "n", "subject", "date_from", "date_to", F.array_join(F.array_sort("participants"), ",").alias("senders"))


@query(f"WITH {TEXT_MAILS} SELECT thread_id FROM (SELECT thread_id FROM tm WHERE text IS NOT NULL AND text != '' AND NOT (subject LIKE '%7%') GROUP BY 1 HAVING count(*) >= 4) ORDER BY md5('42:' || thread_id), thread_id LIMIT 5")
def random_threads(spark, d):
    from ..operators import flows

    return flows.random_threads(_text_mails(spark, d), F.col("subject").contains("7"), 5, 4).select("thread_id")


@query(f"""WITH {TEXT_MAILS}, hi AS (SELECT vec_id AS id, round(0.5 + vec_id % 50 / 100.0, 4)::DOUBLE AS score FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 11 = 0),
ex AS (SELECT id FROM tm WHERE thread_id IN (SELECT thread_id FROM tm JOIN hi USING (id))),
r AS (SELECT tm.id, thread_id, score, hi.id IS NULL AS expanded, CASE WHEN label IS NULL OR label = 0 THEN 'noise' WHEN label % 2 = 0 THEN 'label ' || label ELSE 'cluster_' || label END AS cluster_label FROM ex JOIN tm USING (id) LEFT JOIN hi USING (id) LEFT JOIN embeddings ON vec_id = tm.id)
SELECT *, max(score) OVER (PARTITION BY thread_id) AS thread_score FROM r""")
def search_answers(spark, d):
    from ..operators import flows

    m = _text_mails(spark, d)
    e = tab(spark, d, "embeddings")
    hits = e.where("vec_id % 11 = 0").select(F.col("vec_id").alias("id"), F.round(F.lit(0.5) + F.col("vec_id") % 50 / 100, 4).alias("score")).join(m.select("id"), "id", "left_semi")
    members = e.select(F.col("vec_id").alias("email_id"), F.when(F.col("label") != NOISE, F.col("label")).alias("cluster_id"), F.lit("hdbscan").alias("source"))
    named = e.where("label % 2 = 0").select(F.col("label").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label")).distinct()
    return flows.answers(m, hits, members, named).select("id", "thread_id", "score", "expanded", "cluster_label", "thread_score")


@query(f"""WITH {PERSONS}, q AS (SELECT id FROM m ORDER BY md5('42:' || id), id LIMIT 200), hx AS (SELECT sender AS person FROM m SEMI JOIN q USING (id) UNION ALL SELECT person FROM r SEMI JOIN q USING (id)),
v AS (SELECT s_nationkey AS community, count(*)::BIGINT AS votes FROM hx JOIN supplier ON s_suppkey = person GROUP BY 1 ORDER BY votes DESC, community LIMIT 1)
SELECT community, votes AS hit_score, 200::BIGINT AS n_found, 200::BIGINT AS n_direct, community % 2 = 0 AS active FROM v""")
def ask_community(spark, d):
    """The community (nation) of the persons of 200 found mails."""
    from ..operators import flows

    m = mails(spark, d)
    found = segments.seeded_sample(m.select("id"), [], "id", 200).withColumns({"expanded": F.lit(False), "person_expanded": F.lit(False)})
    people = persons.person_stats(m.join(found.select("id"), "id", "left_semi"), "sender", "recipients", "day")
    s = tab(spark, d, "supplier")
    groups = s.select(F.col("s_nationkey").alias("community"), F.when(F.col("s_nationkey") % 2 == 0, "1998-07").otherwise("1990-01").alias("last")).distinct()
    return flows.ask(found, people, s.select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("community")), groups, AS_OF).drop("top5")


@query("""WITH t AS (SELECT doc_id, coalesce(source, '-') AS folder, '<' || doc_id // 2 || '@x>' AS message_id, text FROM documents),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY folder, doc_id) = 1)
SELECT folder, doc_id AS imap_uid, message_id, 'Subject ' || doc_id AS subject, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))[:1000] AS body_text FROM f WHERE message_id NOT IN (SELECT '<' || doc_id // 2 || '@x>' FROM documents WHERE doc_id % 20 = 0)""")
def sync_messages(spark, d):
    """documents as fetched messages, every second one with the id of the one before; some ids are there already."""
    from ..operators import flows

    docs = tab(spark, d, "documents")
    mid = F.concat(F.lit("<"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("@x>"))
    head = F.concat(F.lit("From: a@x.example\nSubject: Subject "), F.col("doc_id").cast("string"), F.lit("\nMessage-ID: "), mid, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    m = docs.select(F.coalesce("source", F.lit("-")).alias("folder"), F.col("doc_id").alias("uid"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    there = docs.where("doc_id % 20 = 0").select(mid.alias("message_id"))
    state = spark.range(0).select(F.lit("").alias("folder"), F.lit(0).cast("long").alias("last_uid"))
    return flows.sync(m, there, state)["emails"].select("folder", "imap_uid", "message_id", "subject", "body_text")


@query("""WITH s AS (SELECT c_mktsegment AS folder, c_custkey AS uid, c_nationkey AS n FROM customer), w AS (SELECT folder, CASE WHEN folder IN ('BUILDING', 'MACHINERY') THEN quantile_disc(uid, 0.5) ELSE 0 END AS last FROM s GROUP BY 1)
SELECT folder, uid FROM s JOIN w USING (folder) WHERE uid > last AND (last > 0 OR '2024-01-' || lpad((n + 1)::VARCHAR, 2, '0') >= '2024-01-10')""")
def uids_to_fetch(spark, d):
    from ..sources.mailbox import uids_to_fetch as pick

    s = tab(spark, d, "customer").select(F.col("c_mktsegment").alias("folder"), F.col("c_custkey").alias("uid"), F.concat(F.lit("2024-01-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")).alias("day"))
    state = s.where("folder IN ('BUILDING', 'MACHINERY')").groupBy("folder").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY uid)").cast("long").alias("last_uid"))
    return pick(s, state, since="2024-01-10")


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label != 0 GROUP BY 1), k AS (SELECT label, row_number() OVER (ORDER BY label) AS id, n FROM s)
SELECT vec_id AS email_id, id AS cluster_id, CASE WHEN id IS NOT NULL THEN 'cluster_' || e.label END AS label, n AS size FROM embeddings e LEFT JOIN k USING (label)""")
def replaced_clusters(spark, d):
    from ..schemas import schema
    from ..sources.mailbox import replace_clusters

    empty = lambda name, *columns: spark.createDataFrame([], schema(name)).select(*columns)
    found = tab(spark, d, "embeddings").select(F.col("vec_id").alias("email_id"), F.when(F.col("label") != NOISE, F.col("label")).alias("cluster"), F.lit(1.0).alias("confidence"))
    c, m = replace_clusters(empty("clusters", "id", "label", "description", "size", "created_at", "updated_at"), empty("email_clusters", "email_id", "cluster_id", "confidence", "source", "created_at"), found, "hdbscan", "now")
    return m.join(c.select(F.col("id").alias("cluster_id"), "label", "size"), "cluster_id", "left").select("email_id", "cluster_id", "label", "size")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 5 != 0 OR o_orderkey % 3 = 0")
def upserted(spark, d):
    from ..sources.mailbox import upsert

    o = tab(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return upsert(o.where("id % 5 != 0").withColumn("v", F.lit("old")), o.where("id % 3 = 0").withColumn("v", F.lit("new")), "id")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 25")
def stratified_sample(spark, d):
    return segments.seeded_sample(tab(spark, d, "documents"), ["lang"], "doc_id", 25).select("lang", "doc_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE start")
def changed_runs(spark, d):
    return segments.runs(tab(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("user_id", "event_id")


@query("""WITH g AS (SELECT o_orderpriority AS folder, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS missing, substr(max(strftime(o_orderdate, '%Y-%m-%d')), 1, 10) AS last FROM orders GROUP BY 1) SELECT folder, n, missing FROM g WHERE n >= 50""")
def large_folders(spark, d):
    from ..operators import flows

    o = tab(spark, d, "orders").select(F.col("o_orderpriority").alias("folder"), F.when(F.col("o_orderkey") % 4 != 0, "x").alias("body_text"))
    return flows.large_folders(o)


# ---- reports


@query("""WITH g AS (SELECT o_custkey AS tid, (o_custkey // 2) * 12 + month(o_orderdate) AS cid FROM orders),
s AS (SELECT count(DISTINCT cid) AS c, count(*) AS n FROM g GROUP BY tid), m AS (SELECT count(DISTINCT tid) AS c, count(*) AS n FROM g GROUP BY cid)
SELECT 'split' AS kind, count(*) AS groups, sum(n)::BIGINT AS mails FROM s WHERE c > 1 UNION ALL SELECT 'merge', count(*), sum(n)::BIGINT FROM m WHERE c > 1""")
def changed_groups(spark, d):
    return reports.changed_groups(_regrouped(spark, d), "tid", "cid")


def _regrouped(spark, d):
    return tab(spark, d, "orders").select(F.col("o_custkey").alias("tid"), (F.floor(F.col("o_custkey") / 2) * 12 + F.month("o_orderdate")).alias("cid"), day("o_orderdate").alias("day"))


@query("""WITH g AS (SELECT o_custkey AS tid, (o_custkey // 2) * 12 + month(o_orderdate) AS cid, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
e AS (SELECT cid, tid, count(*) AS n, min(day) AS first, max(day) AS last FROM g GROUP BY 1, 2), l AS (SELECT cid, sum(n)::BIGINT AS total FROM e GROUP BY 1 HAVING count(*) > 1 ORDER BY total DESC, cid LIMIT 3)
SELECT cid, total, tid, n, first, last FROM e JOIN l USING (cid) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY tid) <= 4""")
def change_examples(spark, d):
    return reports.change_examples(_regrouped(spark, d), "cid", "tid", "day")


COMMUNITIES = f"""{DEGREES}, pe AS (SELECT s_suppkey AS person, s_suppkey % 5 AS community, s_suppkey % 3 = 0 AS internal, 'd' || (s_suppkey % 7) || '.example' AS domain, coalesce(c, 0) AS c FROM supplier LEFT JOIN ce ON node = s_suppkey),
ma AS (SELECT DISTINCT community, o_orderkey AS id, o_orderpriority AS subject, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN pe ON person = l_suppkey),
t5 AS (SELECT community, string_agg(person::VARCHAR, ',' ORDER BY c DESC, person) AS top5 FROM (FROM pe QUALIFY row_number() OVER (PARTITION BY community ORDER BY c DESC, person) <= 5) GROUP BY 1),
dm AS (SELECT community, domain, count(*) AS n FROM pe WHERE NOT internal GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, domain) <= 5),
d5 AS (SELECT community, string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain) AS ext_doms FROM dm GROUP BY 1),
wo AS (SELECT community, word, count(*) AS n FROM (SELECT community, unnest(regexp_extract_all(lower(subject), '[a-z]{{3,}}')) AS word FROM ma) WHERE word != 'not' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, word) <= 12),
w5 AS (SELECT community, string_agg(word || ':' || n, ',' ORDER BY n DESC, word) AS top_words FROM wo GROUP BY 1)"""


@query(f"""WITH {COMMUNITIES} SELECT community, size, n_int, n_ext, top5, ext_doms, top_words, n_emails, first, last FROM
(SELECT community, count(*) AS size, count(*) FILTER (internal) AS n_int, count(*) FILTER (NOT internal) AS n_ext FROM pe GROUP BY 1 HAVING count(*) >= 2) JOIN t5 USING (community) LEFT JOIN d5 USING (community) LEFT JOIN w5 USING (community)
LEFT JOIN (SELECT community, count(DISTINCT id) AS n_emails, min(day)[:7] AS first, max(day)[:7] AS last FROM ma GROUP BY 1) USING (community)""")
def community_summary(spark, d):
    s = F.col("s_suppkey")
    people = tab(spark, d, "supplier").select(s.alias("person"), (s % 5).alias("community"), (s % 3 == 0).alias("internal"), F.concat(F.lit("d"), (s % 7).cast("string"), F.lit(".example")).alias("domain"))
    m = tab(spark, d, "orders").join(tab(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = m.select(F.col("o_orderkey").alias("id"), F.col("l_suppkey").alias("person"), F.col("o_orderpriority").alias("subject"), day("o_orderdate").alias("day"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[c_of[c]], x["n"].cast("string"))), ",").alias(c)
    c_of = {"ext_doms": "domain", "top_words": "word"}
    out = reports.community_summary(_edges(spark, d), people, m, ("not",), 2)
    return out.select("community", "size", "n_int", "n_ext", F.array_join(F.transform("top5", lambda x: x.cast("string")), ",").alias("top5"), flat("ext_doms"), flat("top_words"), "n_emails", "first", "last")


@query("""WITH s AS (SELECT round(l_discount + l_tax, 4) >= 0.1 AS passed, unnest([{'signal': 'discount', 'x': l_discount}, {'signal': 'tax', 'x': l_tax}], recursive := true) FROM lineitem),
g AS (SELECT signal, passed, count(*) AS n, median(x) AS median, avg(x) AS mean, min(x) AS low, max(x) AS high, count(*) FILTER (x = 0) AS zeros, sum(x) AS s FROM s GROUP BY 1, 2)
SELECT signal, passed, n, round(median, 4) AS median, round(mean, 4) AS mean, low, high, zeros, round(100 * s / sum(s) OVER (PARTITION BY passed), 3) AS share FROM g""")
def signal_stats(spark, d):
    s = tab(spark, d, "lineitem").select(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_discount") + F.col("l_tax")).alias("total"))
    g = reports.signal_stats(s, ["discount", "tax"], "total", 0.1)
    return g.withColumns({c: F.round(c, 4) for c in ("median", "mean")}).withColumn("share", F.round("share", 3))


@query(f"""WITH {SAMPLE}, p AS (SELECT x.label = y.label AS same, {COS.format('x.v', 'y.v')} AS s FROM a x JOIN a y ON x.vec_id < y.vec_id), r AS (SELECT avg(s) FILTER (same) AS a, avg(s) FILTER (NOT same) AS b FROM p)
SELECT round(a, 4) AS related, round(b, 4) AS unrelated, round(a - b, 4) AS gap FROM r""")
def similarity_gap(spark, d):
    g = reports.separation(_sampled_pairs(spark, d), "same", "s")
    return g.select(*[F.round(c, 4).alias(c) for c in g.columns])


@query("""WITH f AS (SELECT DISTINCT conv_id, split_part(trim(text), ' ', 1) AS fact FROM conversations WHERE text IS NOT NULL AND trim(text) != ''), a AS (SELECT role AS model, conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY 1, 2)
SELECT model, conv_id, count(*) FILTER (contains(lower(t), lower(fact))) AS found, count(*) AS facts FROM a JOIN f USING (conv_id) GROUP BY 1, 2""")
def fact_scores(spark, d):
    c = tab(spark, d, "conversations")
    facts = c.select("conv_id", F.split(F.trim("text"), " ")[0].alias("fact")).where("fact != ''").distinct().select("conv_id", F.array("fact").alias("variants"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text")
    return reports.fact_scores(c.groupBy(F.col("role").alias("model"), "conv_id").agg(texts), facts, "conv_id")


@query("""WITH g AS (SELECT role AS model, count(*) AS calls, sum(length(text))::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out FROM conversations GROUP BY 1),
c AS (SELECT *, (tokens_in * CASE model WHEN 'user' THEN 3.0 ELSE 0.0 END::DOUBLE + tokens_out * CASE model WHEN 'user' THEN 15.0 ELSE 0.0 END::DOUBLE) / 1000000 AS cost FROM g)
SELECT model, calls, tokens_in, tokens_out, round(cost, 8) AS cost, round(cost / calls, 10) AS cost_each, round(cost / calls * 30, 8) AS cost_month FROM c""")
def model_costs(spark, d):
    calls = tab(spark, d, "conversations").select(F.col("role").alias("model"), F.length("text").cast("long").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    g = reports.costs(calls, {"user": (3.0, 15.0)})
    return g.withColumns({"cost": F.round("cost", 8), "cost_each": F.round("cost_each", 10), "cost_month": F.round("cost_month", 8)})


@query("""WITH m AS (SELECT label, source AS subject, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings JOIN documents ON doc_id = vec_id QUALIFY i <= 10),
n AS (SELECT *, trim(t[:150])[:120] AS s FROM m)
SELECT label AS cluster, string_agg(i || '. ' || coalesce(subject, '') || CASE WHEN s != '' AND s != coalesce(subject, '') THEN chr(10) || '   ' || s ELSE '' END, chr(10) ORDER BY i) AS lines FROM n GROUP BY 1""")
def label_prompts(spark, d):
    docs = tab(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("subject"), F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, 150).alias("body_snippet"))
    m = tab(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster")).join(docs, "vec_id")
    return reports.label_lines(m, "cluster", [F.col("vec_id")])


@query("""WITH n AS (SELECT s_suppkey AS person, s_nationkey AS community, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY community)::BIGINT AS total FROM n)
SELECT * FROM t WHERE n >= greatest(5, total // 40)""")
def alternative_names(spark, d):
    n = tab(spark, d, "lineitem").join(tab(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("community")).agg(F.count("*").alias("n"))
    return reports.alternative_names(n.withColumn("total", F.sum("n").over(Window.partitionBy("community"))), "community", "total")
