"""What the training-data operators share: the shared folder, tables that cut lineage, Arrow batch sizes."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python workers: rows are whole documents, so few of them make a batch.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. It is set here only where it is unset and all
    runs in one process (tests); on a cluster an unset folder is an error, as a local one would be seen by nobody else."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Where tables of the running application lie, until they are dropped or swept.
_written: set[str] = set()


def table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.add(at)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(conf).delete(path, True)
    _written.discard(at)


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing still to be computed reads, such as those of a loop's round before."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def written() -> frozenset[str]:
    """Where the tables lie that operators have written so far."""
    return frozenset(_written)


def _changed(spark: SparkSession, at: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def sweep(tables: frozenset[str], stored: DataFrame) -> None:
    """Delete ``tables`` that have done their work: ``stored`` is read from files that are younger than all of them, so it
    is what came of them, and none of them is among its files. In doubt all stay."""
    tables, spark = tables & _written, stored.sparkSession
    files = stored.inputFiles() if tables else []
    if files and not any(at.removeprefix("file://") in f for f in files for at in tables):
        if min(_changed(spark, f) for f in files[:1]) >= max(_changed(spark, at) for at in tables):
            for at in tables:
                _delete(spark, at)


def fresh(names: list[str], *wanted: str) -> dict[str, str]:
    """A private column name for each of ``wanted`` that clashes with none of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    out = {}
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out[w] = name
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def utf8(name: str):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, from one scan of the column."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has as a DataFrame that no Python worker touches, by way of one literal text, so plans stay
    small. ``schema``: ``name type, ...``."""
    names = [x.split()[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ",".join("{}:{}".format(*x.split()) for x in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def quoted(*names: str) -> list[Column]:
    """Columns of these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


class Tidy:
    """A function for mapInArrow that gives memory back when its partition ends, as Python workers live on between tasks."""

    def __init__(self, run, *then):
        self.run, self.then = run, then

    def __call__(self, batches):
        try:
            yield from self.run(batches)
        finally:
            for f in self.then:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass
