"""Landed rows appended once each, as a stream that ends when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.mailbox import new_rows


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: StructType, key: str, order: str) -> None:
    """Appends parquet rows of ``landing`` whose key ``target`` lacks; a second run, or a repeated batch, adds nothing."""

    def append(batch: DataFrame, _: int) -> None:
        try:
            there = batch.sparkSession.read.schema(schema).parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = batch.limit(0)
        new_rows(batch, there, key, order).write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).parquet(landing)
    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def session_blocks(events: DataFrame, ts: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a key that a gap ends; late rows within the watermark still count."""
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
