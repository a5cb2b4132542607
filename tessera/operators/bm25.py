"""Word search: BM25 ranks and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .components import drop, written

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, doc_id: str, *columns: str) -> DataFrame:
    """(id, tokens) of each document."""
    return docs.select(F.col(doc_id).alias("id"), F.concat(*[words(F.col(c)) for c in columns]).alias("tokens"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, terms, ns): the different terms of each row (id, tokens) and how often it has them."""
    for b in batches:
        tokens = b.column(1)
        lengths = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
        flat = tokens.flatten().dictionary_encode()
        kinds = max(1, len(flat.dictionary))
        keys, ns = np.unique(np.repeat(np.arange(b.num_rows), lengths) * kinds + np.asarray(flat.indices, np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1) * kinds).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (flat.dictionary.take(pa.array(keys % kinds)), pa.array(ns.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths.astype(np.int32)), *lists], ["id", "length", "terms", "ns"])


#: Parts of an index; a query reads those of its terms.
PARTS = 64


class Index:
    """Postings (term, id, n) in parts by the term's hash, and the documents' lengths: written once, read by every query."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str, columns: list[str], path: str) -> Index:
        """Texts are read and cut into terms once, and a document's terms are counted before they leave it; what is
        shuffled, once, is a row for each of its different terms."""
        tokens = postings(docs, doc_id, *columns)
        kind = tokens.schema["id"].dataType.simpleString()
        counts = written(tokens.mapInArrow(_count, f"id {kind}, length int, terms array<string>, ns array<int>"), "counts")  # read twice
        counts.select("id", "length").write.mode("overwrite").parquet(f"{path}/lengths")
        each = counts.select("id", F.explode(F.arrays_zip("terms", "ns")).alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.ns").alias("n"))
        each = each.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).repartition(PARTS, "part")
        each = each.groupBy("part", "term", "id").agg(F.sum("n").cast("int").alias("n")).select("id", "term", "n", "part")  # an id may have several rows
        each.sortWithinPartitions("part", "term", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        drop(counts)
        return cls(docs.sparkSession, path)

    def hits(self, terms: list[str]) -> DataFrame:
        """(term, id, n) of the terms; parts and row groups without them aren't read."""
        parts = [r[0] for r in self.postings.sparkSession.range(1).select(F.explode(F.transform(F.array(*map(F.lit, terms)), lambda t: F.pmod(F.xxhash64(t), F.lit(PARTS)).cast("int")))).collect()]
        return self.postings.where(F.col("part").isin(parts) & F.col("term").isin(terms)).select("term", "id", "n")

    def hit_count(self, terms: list[str]) -> DataFrame:
        """(hits): documents with any of the terms."""
        return self.hits(terms).agg(F.count_distinct("id").alias("hits"))

    def ranks(self, terms: list[str]) -> DataFrame:
        """(id, rank) as ``bm25`` gives them."""
        hits = self.hits(terms)
        stats = self.lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
        idf = hits.groupBy("term").agg(F.count("*").alias("d")).join(F.broadcast(stats)).withColumn("idf", F.log((F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5)))
        idf = F.broadcast(idf.select("term", "mean", F.when(F.col("idf") <= 0, FLOOR).otherwise(F.col("idf")).alias("idf")))  # a row for each term
        rows = hits.join(idf, "term").join(self.lengths, "id")
        part = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return rows.groupBy("id").agg((-F.sum(part)).alias("rank"))


def bm25(docs: DataFrame, doc_id: str, columns: list[str], terms: list[str]) -> DataFrame:
    """(id, rank) of documents with any of the terms (lower-cased, folded); lower ranks are better.

    Only counts of the query's terms leave a document, so the one shuffle moves no text.
    """
    tokens = postings(docs, doc_id, *columns).withColumn("length", F.size("tokens"))
    times = lambda t: F.size(F.filter("tokens", lambda x: x == F.lit(t)))
    counts = {f"t{i}": times(t) for i, t in enumerate(terms)}
    rows = written(tokens.select("id", "length", *[c.alias(n) for n, c in counts.items()]), "terms")  # texts are read once
    stats = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.sum((F.col(n) > 0).cast("long")).alias(f"d{n}") for n in counts])
    joined = rows.where(" OR ".join(f"{n} > 0" for n in counts)).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for n in counts:
        idf = F.log((F.col("docs") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        idf = F.when(idf <= 0, FLOOR).otherwise(idf)
        total += idf * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.select("id", (-total).alias("rank"))


def word_scores(ranks: DataFrame, limit: int = 300) -> DataFrame:
    """(id, score) of the best ``limit``: from 0.7 for the worst of them to 1.0 for the best; all equal give 1.0."""
    best = ranks.orderBy("rank", "id").limit(limit)
    low, high = F.min("rank").over(Window.partitionBy()), F.max("rank").over(Window.partitionBy())
    return best.select("id", F.when(low == high, 1.0).otherwise(0.7 + 0.3 * (F.col("rank") - high) / (low - high)).alias("score"))
