"""Connected components by least labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Only a session in one process (tests)
    may do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of the shared folder, which cuts its lineage and outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def written_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``df`` by way of the shared folder in buckets of ``key``, so that groups of the key are made without a shuffle."""
    path, table = shared_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(table, format="parquet")
    out = df.sparkSession.table(table)
    out.written_at, out.table = path, table
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing still to be computed reads."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "table"):
            spark.sql(f"DROP TABLE {t.table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Parts into which the rows of a hot key are dealt, and the share of all rows (1 / HOT) from which a key is hot. Tables
#: of up to FEW rows fit into one task, so nothing in them is dealt.
SALTS, HOT, FEW = 16, 2000, 1_000_000


def spread_edges(both: DataFrame) -> DataFrame:
    """Adds ``salt`` to edges (a, b): edges into a hub are dealt over SALTS parts by their other end, others have 0.
    Fewer than HOT nodes have more than 1 / HOT of the edges, so the hubs can be broadcast."""
    least = max(1000, both.count() // HOT)
    hubs = both.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("hub")
    return both.join(F.broadcast(hubs), both["b"] == hubs["hub"], "left").select("a", "b", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))


def step(both: DataFrame, labels: DataFrame, hubs: DataFrame | None, salts: int = SALTS) -> DataFrame:
    """(node, component, old) after one round over edges (a, b, salt): least labels of neighbours, then the label's label.

    Neither a hub nor a label that most nodes have meets in one task: hubs' labels are repeated for each salt, and so are
    the labels of those labels that still move, which are all that the second join needs.
    """
    at = labels.select("node", "component", F.lit(0).alias("salt"))
    if hubs is not None:
        at = at.unionByName(hubs.join(labels, hubs["b"] == labels["node"]).select("node", "component", "salt"))
    near = both.join(at, (both["b"] == at["node"]) & (both["salt"] == at["salt"])).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
    new = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
    new = written(new, "near")
    used = new.select(F.col("new").alias("up")).distinct()
    up = new.where("new != node").join(used, F.col("node") == F.col("up")).select("up", F.col("new").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    part = F.pmod(F.xxhash64("node"), F.lit(salts))
    return new.withColumn("p", part).join(up, (F.col("new") == F.col("up")) & (F.col("p") == F.col("part")), "left").select("node", F.least("new", "further").alias("component"), "old")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b). Each round spreads least labels to neighbours and
    then takes the label's label, so rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    both = written(spread_edges(both), "edges")
    # a node's first label is the least of its neighbours' and its own
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    labels = nodes.select("node").join(least, F.col("node") == F.col("n"), "left").select("node", F.least("node", "m").alias("component"))
    labels = written(labels, "labels")
    hubs = written(both.where("salt > 0").select("b", "salt").distinct(), "hubs")
    hubs, salts = (hubs if hubs.limit(1).count() else None), (SALTS if labels.count() > FEW else 1)
    while True:
        new = written(step(both, labels, hubs, salts), "labels")
        labels = new.select("node", "component")
        if not new.where("component != old").limit(1).count():
            return labels
