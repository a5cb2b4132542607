"""Hybrid search: words, vectors and clusters fused in one plan; thread and person expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.vectors import centroids, cosine
from .bm25 import Index, bm25, word_scores
from .topics import cluster_scores, vector_top_k


def fuse(signals: list[tuple[DataFrame, str, float]], k: int) -> DataFrame:
    """(id, score): weighted sums of signals (frame, column, weight), a missing one counting 0; the best ``k``."""
    rows = None
    for df, column, weight in signals:
        part = df.select("id", (F.col(column) * weight).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(mails: DataFrame, members: DataFrame, terms: list[str], query: list[float], config: EngineConfig = EngineConfig(), columns: tuple[str, ...] = ("subject", "body_text"), index: Index | None = None) -> DataFrame:
    """(id, score) over mails (id, ...) and members (id, cluster, vector): the top k, then those whose rounded score suffices.
    With an ``index`` of the mails, their texts aren't read."""
    words = word_scores(index.ranks(terms) if index else bm25(mails, "id", list(columns), terms), config.fts_limit)
    vectors = vector_top_k(members, "id", "vector", query, config.vector_k)
    clusters = cluster_scores(members, query, config.cluster_decay, config.noise_penalty)
    a, b, c = config.weights
    best = fuse([(words, "score", a), (vectors, "similarity", b), (clusters, "score", c)], config.top_k)
    return best.where(F.round("score", 4) >= config.min_score)


def expand_threads(hits: DataFrame, mails: DataFrame, key: str = "id", thread: str = "thread_id") -> DataFrame:
    """(key, thread, expanded): the hits, and the other mails of their threads."""
    found = mails.join(hits.select(key), key, "left_semi")
    threads = found.select(thread).where(F.col(thread).isNotNull()).distinct()
    more = mails.join(threads, thread, "left_semi").join(hits.select(key), key, "left_anti")
    return found.select(key, thread, F.lit(False).alias("expanded")).unionByName(more.select(key, thread, F.lit(True).alias("expanded")))


def expand_persons(direct: DataFrame, known: DataFrame, mails: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(id, score): mails of the seeds (senders of the direct hits) around the hits' dates, with enough seeds among sender
    and recipients, and close enough to the centroid of the hits; a mail without a vector stays, with a null score.

    Mails: id, date (string), from_address, to_addresses (array of strings), vector.
    """
    hits = mails.join(direct.select("id"), "id", "left_semi")
    day = lambda f, days: F.concat(F.date_format(F.date_add(F.to_date(F.substring(f("date"), 1, 10)), days), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    bounds = hits.agg(day(F.min, -config.window_days).alias("low"), day(F.max, config.window_days).alias("high"), F.collect_set("from_address").alias("seeds"))  # of top_k hits
    center = centroids(hits.where("vector IS NOT NULL").withColumn("one", F.lit(1)), "one", "vector").select("centroid")
    rows = mails.join(F.broadcast(bounds)).where("date >= low AND date <= high AND array_contains(seeds, from_address)").join(known.select("id"), "id", "left_anti")
    rows = rows.where(F.size(F.array_intersect(F.array_union(F.array("from_address"), "to_addresses"), "seeds")) >= config.min_overlap)
    rows = rows.crossJoin(F.broadcast(center.agg(F.first("centroid").alias("centroid"))))
    score = F.when(F.col("vector").isNotNull() & F.col("centroid").isNotNull(), cosine(F.col("vector"), F.col("centroid")))
    return rows.select("id", score.alias("score")).where(F.col("score").isNull() | (F.col("score") > config.context_threshold))


def with_labels(ids: DataFrame, mails: DataFrame, membership: DataFrame, clusters: DataFrame, source: str = "hdbscan", none: str = "noise") -> DataFrame:
    """Mails of the ids with their cluster's label, or its number's name; ``none`` without a cluster."""
    m = membership.where(F.col("source") == source).select(F.col("email_id").alias("id"), "cluster_id")
    c = clusters.select(F.col("id").alias("cluster_id"), "label")
    name = F.coalesce("label", F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")), F.lit(none))
    return mails.join(ids.select("id"), "id", "left_semi").join(m, "id", "left").join(c, "cluster_id", "left").withColumn("cluster_label", name).drop("label")


def group_threads(results: DataFrame) -> DataFrame:
    """Results (id, thread_id, score, date) with their thread's best score, in order: best threads first, threadless last."""
    from pyspark.sql import Window

    best = F.max("score").over(Window.partitionBy("thread_id"))
    return results.withColumn("thread_score", best).orderBy(F.col("thread_id").isNull(), F.desc_nulls_last("thread_score"), "thread_id", F.asc_nulls_first("date"), "id")
