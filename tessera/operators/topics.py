"""Vector search, cluster signals, topics and density clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroids, cosine


def vector_top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int = 100) -> DataFrame:
    """(id, similarity) of the ``k`` rows most like the query, clipped at 0; ties go to the least id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sims = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), cosine(F.col(vector), q).alias("s"))
    return sims.orderBy(F.desc("s"), "id").limit(k).select("id", F.greatest("s", F.lit(0.0)).alias("similarity"))


def cluster_scores(members: DataFrame, query: list[float], decay: tuple[float, ...] = (1.0, 0.7, 0.5), penalty: float = -0.1) -> DataFrame:
    """(id, score) over members (id, cluster, vector): the similarity of the row's cluster to the query, for the nearest
    clusters, decaying by rank; rows of no cluster (null) get the penalty."""
    q = F.array(*[F.lit(float(x)) for x in query])
    c = centroids(members.where("cluster IS NOT NULL"), "cluster", "vector", pre_normalise=True)
    near = c.select("cluster", cosine(F.col("centroid"), q).alias("s")).orderBy(F.desc("s"), "cluster").limit(len(decay))
    ranked = near.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "cluster")))
    weight = F.element_at(F.array(*[F.lit(x) for x in decay]), F.col("r"))
    scores = F.broadcast(ranked.select("cluster", (F.greatest("s", F.lit(0.0)) * weight).alias("score")))  # len(decay) rows
    hits = members.join(scores, "cluster").groupBy("id").agg(F.max("score").alias("score"))
    noise = members.where("cluster IS NULL").select("id", F.lit(penalty).alias("score")).join(hits, "id", "left_anti")
    return hits.unionByName(noise)


#: Numbers in all centroids up to which they travel to the tasks as one matrix.
MATRIX_LIMIT = 4_000_000


def _choose(names: list, matrix: np.ndarray, deviations: float, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.stack([np.asarray(x, np.float64) for x in b.column(1).to_pylist()])
            lengths = np.linalg.norm(v, axis=1, keepdims=True)
            sims = v / np.where(lengths > 0, lengths, 1) @ matrix.T
            order = np.argsort(-sims, axis=1, kind="stable")
            ranked = np.take_along_axis(sims, order, 1)
            over = ranked >= ranked.mean(1, keepdims=True) + deviations * ranked.std(1, keepdims=True)
            low = ~over.any(1)
            over[low, 0] = True
            row, rank = np.nonzero(over)
            picked = order[row, rank]
            columns = [b.column(0).take(pa.array(row)), pa.array([names[i] for i in picked]), pa.array(ranked[row, rank]), pa.array((rank + 1).astype(np.int32)), pa.array(low[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, [b.column(0).type, pa.int64(), pa.float64(), pa.int32(), pa.int32()], strict=True)], fields)

    return run


def topics(df: DataFrame, key: str, vector: str, centers: DataFrame, deviations: float = 2.0) -> DataFrame:
    """(id, cluster, similarity, rank, low_confidence): the centroids at least ``deviations`` population deviations over
    a row's mean similarity, or else the nearest with low confidence; ties go to the lesser cluster.

    Up to MATRIX_LIMIT numbers the centroids go to every task as one matrix, and a batch is one product; beyond, rows
    and centroids are joined, and a row's similarities are ranked in a window.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    size = centers.agg(F.sum(F.size("centroid")).alias("n")).first()["n"] or 0
    fields = ["id", "cluster", "similarity", "rank", "low_confidence"]
    if size <= MATRIX_LIMIT:
        known = centers.select(F.col("cluster").cast("long"), "centroid").orderBy("cluster").collect()
        if not known:
            return rows.select("id", F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("double").alias("similarity"), F.lit(0).alias("rank"), F.lit(0).alias("low_confidence")).limit(0)
        matrix = np.stack([np.asarray(r["centroid"], np.float64) for r in known])
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        run = _choose([r["cluster"] for r in known], matrix / np.where(lengths > 0, lengths, 1), deviations, fields)
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster long, similarity double, rank int, low_confidence int")
    part = Window.partitionBy("id")
    sims = rows.join(centers).select("id", F.col("cluster").cast("long").alias("cluster"), cosine(F.col("v"), F.col("centroid")).alias("similarity"))
    ok = F.col("similarity") >= F.avg("similarity").over(part) + deviations * F.stddev_pop("similarity").over(part)
    sims = sims.withColumn("ok", ok).withColumn("any", F.max("ok").over(part)).withColumn("rank", F.row_number().over(part.orderBy(F.desc("similarity"), "cluster")))
    return sims.where("ok OR (NOT any AND rank = 1)").withColumn("low_confidence", (~F.col("any")).cast("int")).select(*fields)


#: Rows of a block of vectors, whose similarities with another block are one matrix.
BLOCK_ROWS = 1000


def _links(threshold: float):
    def unit(column, i: int) -> np.ndarray:
        rows = column[i].values  # a list of vectors; its numbers are one buffer
        v = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
        lengths = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(lengths > 0, lengths, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                same = b.column(0)[i].as_py() == b.column(3)[i].as_py()
                sims = unit(b.column(2), i) @ unit(b.column(5), i).T
                x, y = np.nonzero((np.triu(sims, 1) if same else sims) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(k)[i].values.take(pa.array(at)) for k, at in ((1, x), (4, y))], ["a", "b"])

    return run


def density_clusters(df: DataFrame, key: str, vector: str, threshold: float, min_size: int) -> DataFrame:
    """(id, cluster, confidence), cluster null for noise: components of rows at least ``threshold`` (above 0) alike, of
    ``min_size`` rows or more. Stands in for hierarchical density clustering. All pairs are compared, block by block, so
    no link is lost; the work grows with the square of the rows."""
    from .components import connected_components, written

    rows = written(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v")), "vectors")
    kind, count = rows.schema["id"].dataType.simpleString(), -(-rows.count() // BLOCK_ROWS) or 1
    blocks = written(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("n")).agg(F.collect_list(F.struct("id", "v")).alias("x")).select("n", F.col("x.id").alias("ids"), F.col("x.v").alias("vs")), "blocks")
    both = blocks.join(blocks.select(*[F.col(c).alias(f"{c}_b") for c in blocks.columns]), F.col("n") <= F.col("n_b"))
    close = written(both.mapInArrow(_links(threshold), f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links").where("a < b")
    labels = connected_components(rows.select(F.col("id").alias("node")), close)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    members = labels.join(sizes, "component", "left").select(F.col("node").alias("id"), F.when(F.col("n").isNotNull(), F.col("component")).alias("cluster"))
    centers = centroids(members.join(rows, "id").where("cluster IS NOT NULL"), "cluster", "v").withColumnRenamed("cluster", "c")
    out = members.join(rows.select("id", "v"), "id").join(centers, F.col("cluster") == F.col("c"), "left")
    sim = cosine(F.col("v"), F.col("centroid"))
    best = F.max(sim).over(Window.partitionBy("cluster"))
    return out.select("id", "cluster", F.when(F.col("cluster").isNotNull(), sim / best).alias("confidence"))
