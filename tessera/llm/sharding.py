"""K-d tree sharding by distributed weighted medians, in DataFrame operations only."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, local_rows, quoted, table

#: A group's place along a dimension: the dimension's value, then the hash of its text, which splits ties.
VALUE_BITS, TEXT_BITS = 10, 53
#: Bits that each pass of the median search reads, at most; together the 63 bits of a place.
PASSES = (10, 14, 13, 13, 13)
#: Groups of more than a HEAVY-th of a shard are dealt before the tree is built; a group of more than FULL shards is cut
#: into pieces of no more.
HEAVY, FULL = 4, 0.9
#: Rows of a shard that one task numbers, and rows of a table from the driver up to which it is broadcast.
SLOT_ROWS, BROADCAST_ROWS = 50_000, 100_000


def _code(name: str) -> Column:
    """A category's coordinate; null lies at 0."""
    return F.coalesce(F.crc32(quoted(name)[0].cast("string")) % ((1 << VALUE_BITS) - 1) + 1, F.lit(0))


def _known(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = local_rows(spark, rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _capacities(loads: list[int], light: int) -> list[float]:
    """What each shard takes of the ``light`` bytes, so that all come as near to one level as their loads allow."""
    level, rest = 0.0, sorted(loads)
    for k in range(len(rest), 0, -1):
        level = (light + sum(rest[:k])) / k
        if level >= rest[k - 1]:
            break
    return [max(0.0, level - x) for x in loads]


def _tree(groups: DataFrame, dims: range, capacities: list[float]) -> DataFrame:
    """(g, shard): leaves of the tree over ``groups`` (g, bytes, v0, v1, ...), whose bytes follow ``capacities``."""
    spark = groups.sparkSession
    ranges = [(F.max(f"v{i}") - F.min(f"v{i}")).alias(f"r{i}") for i in dims]
    total = groups.agg(*ranges).first()
    at = F.element_at(F.array(*[F.col(f"v{i}") for i in dims]), F.col("axis") + 1)
    place = F.shiftleft(at, TEXT_BITS).bitwiseOR(F.col("g").bitwiseAND((1 << TEXT_BITS) - 1))
    rows = groups.withColumn("node", F.lit(0))
    leaves = {0: (0, len(capacities))}  # node -> first shard, number of shards
    share = lambda first, n: sum(capacities[first : first + n])
    while any(n > 1 for _, n in leaves.values()):
        stats = rows.groupBy("node").agg(F.sum("bytes").alias("bytes"), *ranges).collect()  # no more nodes than shards
        cuts = {}  # axis, bits of the cut so far, bytes wanted from there on
        for s in stats:
            first, n = leaves[s["node"]]
            if n > 1:
                axis = max(dims, key=lambda i: (s[f"r{i}"] / max(1, total[f"r{i}"]), -i))
                cuts[s["node"]] = [axis, 0, s["bytes"] * share(first, n // 2) / (share(first, n) or 1)]
        left, ends = sum(PASSES), {}
        for bits in PASSES:
            left -= bits
            state = _known(spark, [(k, *v) for k, v in cuts.items() if k not in ends], "n int, axis int, prefix long, want double")
            bins = (
                rows.join(state, F.col("node") == F.col("n")).withColumn("place", F.shiftright(place, left)).where(F.shiftright("place", bits) == F.col("prefix"))
                .groupBy("node", "place", "want").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
            )
            order = Window.partitionBy("node").orderBy("place")
            bins = bins.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            found = bins.where("upto >= want").groupBy("node").agg(F.min_by(F.struct("place", "want", "bytes", "groups", (F.col("upto") - F.col("bytes")).alias("below")), "place").alias("x"))
            for r in found.collect():
                x = r["x"]
                cuts[r["node"]][1:] = [x["place"], max(0.0, x["want"] - x["below"])]
                if x["groups"] == 1 or not left:  # the nearer side of the group at the cut
                    ends[r["node"]] = (x["place"] + (2 * (x["want"] - x["below"]) >= x["bytes"]) << left) - 1
            if len(ends) == len(cuts):
                break
        state = _known(spark, [(k, v[0], ends[k]) for k, v in cuts.items() if k in ends], "n int, axis int, cut long")
        rows = rows.join(state, F.col("node") == F.col("n"), "left").withColumn("node", 2 * F.col("node") + F.coalesce((place > F.col("cut")).cast("int"), F.lit(0))).drop("n", "axis", "cut")
        after = {}
        for node, (first, n) in leaves.items():
            after[2 * node] = (first, n // 2 if n > 1 else n)
            if n > 1:
                after[2 * node + 1] = (first + n // 2, n - n // 2)
        leaves = after
    names = _known(spark, [(k, v[0]) for k, v in leaves.items()], "n int, shard int")
    return rows.join(names, F.col("node") == F.col("n")).select("g", "shard")


def kd_shards(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("source", "lang"),
    shards: int | None = None,
    target_bytes: int | None = None,
    overhead: int = 8,
) -> DataFrame:
    """Leaves of a k-d tree over the documents: (doc_id, size, text_crc32, shard, slot).

    What is split are groups of equal texts, whose dimensions are the logarithm of the size and the least codes of their
    categories. Every round splits all nodes: each takes its dimension of the widest range, relative to the table's, and
    is cut between two groups, at the weighted quantile that gives its halves bytes in proportion to what their shards
    can take. Quantiles come from histograms over the next bits of the place, in up to five passes a round, so each pass
    moves at most a row for each node, bin and task. Groups of more than a quarter of a shard, which are fewer than four
    times the shards, are dealt to the emptiest shards before; one of more than a shard is cut. Only those and the nodes'
    bounds reach the driver. ``shards`` or ``target_bytes`` sets the number of leaves.

    Null texts count as empty (``overhead`` bytes) and are one group with empty ones; null categories lie at coordinate
    0; null ids and repeated rows are documents like any other; texts of any length are hashed whole; an empty table
    gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    content = F.coalesce(quoted(text)[0], F.lit(""))
    size = (F.octet_length(content) + overhead).cast("long")
    values = [F.least(F.floor(F.log2(size) * 32), F.lit((1 << VALUE_BITS) - 1)), *map(_code, categories)]
    dims = range(len(values))
    base = table(
        docs.select(quoted(doc_id)[0].alias("doc_id"), size.alias("size"), F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"), F.xxhash64(content).alias("g"), *[v.cast("long").alias(f"v{i}") for i, v in enumerate(values)]),
        "kd",
    )
    groups = table(base.groupBy("g").agg(F.sum("size").alias("bytes"), *[F.min(f"v{i}").alias(f"v{i}") for i in dims]), "kd-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    # heavy groups: pieces by a hash of the id, the largest first to the emptiest shard
    target = total / shards
    heavy = groups.where(F.col("bytes") * HEAVY > target).select(F.col("g").alias("h"), F.ceil(F.col("bytes") / (FULL * target)).cast("int").alias("parts")) if total else groups.limit(0).select(F.col("g").alias("h"), F.lit(1).alias("parts"))
    heavy = table(heavy, "kd-heavy")
    heavy = F.broadcast(heavy) if shards * HEAVY <= BROADCAST_ROWS else heavy
    piece = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("piece")
    pieces = base.join(heavy, F.col("g") == F.col("h")).groupBy("h", piece).agg(F.sum("size").alias("bytes")).collect()  # fewer than 5 * shards
    queue, loads, dealt = [(0, i) for i in range(shards)], [0] * shards, []
    for r in sorted(pieces, key=lambda r: (-r["bytes"], r["h"], r["piece"])):
        load, i = heapq.heappop(queue)
        dealt.append((r["h"], r["piece"], i))
        loads[i] = load + r["bytes"]
        heapq.heappush(queue, (loads[i], i))
    light = groups.join(heavy, F.col("g") == F.col("h"), "left_anti")
    if shards > 1 and total > sum(loads):
        leaves = _tree(light, dims, _capacities(loads, total - sum(loads)))
    else:
        leaves = light.select("g", F.lit(0).alias("shard"))
    leaves = table(leaves.withColumnRenamed("g", "k"), "kd-leaves")
    columns = ["doc_id", "size", "text_crc32", "shard", "g"]
    of_heavy = base.join(heavy, F.col("g") == F.col("h")).select("*", piece).drop("h", "parts").join(_known(spark, dealt, "k long, p int, shard int"), (F.col("g") == F.col("k")) & (F.col("piece") == F.col("p")))
    placed = table(base.join(leaves, F.col("g") == F.col("k")).select(columns).unionByName(of_heavy.select(columns)), "kd-shards")
    drop(base, groups, leaves)
    # slots: a shard is numbered in pieces, whose offsets come from their counts
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("pieces"))
    placed = placed.join(F.broadcast(parts) if shards <= BROADCAST_ROWS else parts, "shard").withColumn("piece", F.pmod(F.xxhash64("g", "doc_id"), "pieces"))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("piece")
    offsets = counts.select("shard", "piece", (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("g", "doc_id", "size", "text_crc32")
    return placed.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
