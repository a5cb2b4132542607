"""A corpus pipeline of five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from tessera.llm.common import documents, drop, quoted, sweep, table, written
from tessera.llm.jaccard_join import one_of_each
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.quality import passing
from tessera.llm.secrets import redacted


_left: list[frozenset[str]] = [frozenset()]


def stage(f):
    """Stages follow each other on stored tables, so what the one before has left behind goes once ``docs`` is its result."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(_left[0], docs)
        before = written()
        out = f(spark, docs, sf_dir)
        _left[0] = written() - before
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go, and with them null, empty and short texts.
    Null languages and sources are groups of their own; repeated rows are judged alike; other columns pass through."""
    return passing(docs)


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the least id; of repeated rows one. Rows are dropped,
    not ids, so a text that resembles no other stays whatever its id, and so do texts without a word."""
    return one_of_each(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays. Null and empty texts and texts without a secret don't
    change; repeated rows change alike."""
    return redacted(docs).select(*quoted(*docs.columns))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets; the null source is one of them. Null
    and empty texts weigh nothing and stay as often as their source is repeated whole; repeated rows share their turn."""
    return mixed(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; null and empty texts are an end id alone, repeated rows documents of
    their own, and an empty table has no piece."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, f) in enumerate(STAGES):
        out = table(f(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            drop(docs)
        docs = out
    return docs
