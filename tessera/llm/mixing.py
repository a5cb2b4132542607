"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, fresh, quoted, table

#: Bits of a document's seeded position in its source, and those read at each of the three levels of the cut search.
POSITION_BITS, LEVEL_BITS = 48, 12
#: Source tables up to this many rows are broadcast; beyond it Spark joins by shuffling.
BROADCAST_SOURCES = 10_000


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(quoted(text)[0], F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Water-fill: from (src, source_size) to (src, source_size, target).

    Sources are numbered in code point order, null last, by their place in a sorted table, so no task holds them all.
    Then each round takes the level at which the words left are shared by weight, and clamps the sources that it would
    lift above their cap; levels only rise, so the rounds end when no further source is clamped. Only sums reach the
    driver.
    """
    ordered = per_source.orderBy(F.col("src").isNull(), "src").withColumn("at", F.monotonically_increasing_id())
    ordered = table(ordered, "mix-order")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task of the sort
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    number = (F.col("before") + inside) % len(weights) + 1
    df = table(
        ordered.withColumn("part", part).join(F.broadcast(before), "part")
        .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), number.cast("int")))
        .withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
        .select("src", "source_size", "w", "cap", (F.col("cap") / F.col("w")).alias("ratio")),
        "mix-caps",
    )
    total, level, clamped = None, float("-inf"), -1
    while True:
        under = F.col("ratio") <= level
        s = df.agg(F.sum("source_size").alias("words"), F.count_if(under).alias("clamped"), F.sum(F.when(under, F.col("cap"))).alias("taken"), F.sum(F.when(~under, F.col("w"))).alias("free")).first()
        total = share * float(s["words"] or 0)
        if s["clamped"] == clamped or not s["free"]:
            break
        clamped, level = s["clamped"], (total - (s["taken"] or 0.0)) / s["free"]
    drop(ordered)
    target = F.when(F.col("ratio") <= level, F.col("cap")).otherwise(F.col("w") * F.lit(level)) if s["free"] else F.col("cap")
    return df.select("src", "source_size", target.alias("target"))


def _position(doc_id: str, text: str, seed: int) -> Column:
    """The first bits of the MD5 of ``seed:doc_id``, which SQL engines compute alike; without an id, the text's MD5 stands
    for it."""
    own = F.coalesce(quoted(doc_id)[0].cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(quoted(text)[0], F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), own)), 1, POSITION_BITS // 4), 16, 10).cast("long")


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow table (id, src, size, at), the sources' plan (s, source_size, target, whole, cut, rest), and
    the rows of the cells in which the sources' extra words run out, with the ``extra`` words they give."""
    base = table(docs.select(quoted(doc_id)[0].alias("id"), quoted(source)[0].alias("src"), word_count(text).alias("size"), _position(doc_id, text, seed).alias("at")), "mix")
    per_source = base.groupBy("src").agg(F.sum("size").alias("source_size"))
    quota = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long")
    sources = table(
        source_targets(per_source, weights, share, max_epochs).withColumn("quota", quota).withColumn("whole", whole).withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")),
        "mix-sources",
    )
    rows = sources.count()
    # cut: the bits of the place in the order at which a source's extra words run out; rest: words wanted beyond it
    cut = sources.select("src", F.lit(0).cast("long").alias("cut"), "rest")
    for bits in range(POSITION_BITS - LEVEL_BITS, 0, -LEVEL_BITS):
        known = F.shiftright("at", bits + LEVEL_BITS) == F.col("cut")
        cells = (
            base.join(_small(cut.withColumnRenamed("src", "s"), rows), F.col("src").eqNullSafe(F.col("s")) & known)
            .groupBy("src", F.shiftright("at", bits).alias("cell"), "rest")
            .agg(F.sum("size").alias("words"))
        )
        order = Window.partitionBy("src").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("below", F.col("upto") - F.col("words"))
        hit = cells.where("below <= rest AND rest < upto").select("src", F.col("cell").alias("cut"), (F.col("rest") - F.col("below")).alias("rest"))
        cut = table(hit, "mix-cut")
    known = sources.select(F.col("src").alias("s"), "source_size", "target", "whole")
    last = cut.select(F.col("src").alias("s2"), "cut", "rest")
    both = table(known.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "mix-plan")
    order = Window.partitionBy("src").orderBy("at", "id", "size")
    edge = base.join(_small(both, rows), F.col("src").eqNullSafe(F.col("s"))).where(F.shiftright("at", LEVEL_BITS) == F.col("cut"))
    edge = edge.withColumn("below", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return base, both, edge.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("below"))))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Words that the mix takes of each document: (doc_id, size, source_size, target, taken).

    Each source gets ``target`` words. Every document is repeated ``target // source_size`` times whole; the remaining
    words come from the documents first in a seeded order, the last of which is taken in part, so that a source's
    taken words equal its target rounded. The cut in the seeded order is found by three levels of histograms over
    hash bits, so no window ever spans a source.

    Null or empty texts have size 0 and take 0; texts of any length are counted whole; a null source is a source of its
    own and comes last; repeated rows are documents like any other (rows that share an id share its place in the order,
    rows without one have their text's); an empty table gives an empty result; other columns are ignored.
    """
    base, both, edge = _plan(docs, doc_id, text, source, weights, share, max_epochs, seed)
    both = _small(both, both.count())
    place = F.shiftright("at", LEVEL_BITS)
    clear = base.join(both, F.col("src").eqNullSafe(F.col("s"))).where(F.col("cut").isNull() | (place != F.col("cut")))
    clear = clear.withColumn("extra", F.when(place < F.col("cut"), F.col("size")).otherwise(0))
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    columns = [F.col("id").alias("doc_id"), "size", "source_size", "target", taken]
    return clear.select(*columns).unionByName(edge.select(*columns))


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` repeats it; a part of half a document or more
    counts as a repetition. Texts aren't shuffled: the sources' plan and the few documents at the cuts go to them.

    Null and empty texts, which take no words, stay as often as their source is repeated whole; rows that share an id
    and a source share the repetition at the cut; null sources, null ids and empty tables are as in ``mix``; the columns
    are those of ``docs``, whatever their names.
    """
    _, both, edge = _plan(docs, doc_id, text, source, weights, share, max_epochs, seed)
    own = fresh(docs.columns, "at", "src", "s", "whole", "cut", "e_src", "e_at", "times", "copy")
    sources = _small(both.select(*[F.col(c).alias(own[c]) for c in ("s", "whole", "cut")]), both.count())
    chosen = edge.where("size > 0 AND 2 * extra >= size").select(F.col("src").alias(own["e_src"]), F.col("at").alias(own["e_at"])).distinct()
    chosen = table(chosen, "mix-edge")
    chosen = _small(chosen, chosen.count())
    at, src = F.col(own["at"]), F.col(own["src"])
    rows = docs.withColumns({own["at"]: _position(doc_id, text, seed), own["src"]: quoted(source)[0]})
    rows = rows.join(sources, src.eqNullSafe(F.col(own["s"])))
    rows = rows.join(chosen, src.eqNullSafe(F.col(own["e_src"])) & (at == F.col(own["e_at"])), "left")
    extra = F.coalesce(F.shiftright(at, LEVEL_BITS) < F.col(own["cut"]), F.lit(False)) | F.col(own["e_at"]).isNotNull()
    rows = rows.withColumn(own["times"], F.col(own["whole"]).cast("int") + extra.cast("int")).where(F.col(own["times"]) > 0)
    return rows.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["times"])))).select(*quoted(*docs.columns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || md5('17:' || coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))))[:12])::BIGINT AS place FROM documents
), g AS (
  SELECT src, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY src
), c AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total, 2 * source_size::DOUBLE AS cap, 2 * source_size::DOUBLE / w AS ratio FROM g
), l AS (
  SELECT *, ratio <= (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM c WINDOW o AS (ORDER BY ratio, src NULLS LAST)
), t AS (
  SELECT src, source_size, CASE WHEN capped THEN cap ELSE w * ((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(w) FILTER (NOT capped) OVER ()) END AS target FROM l
), q AS (
  SELECT *, round(target)::BIGINT AS quota, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t
), b AS (
  SELECT d.*, source_size, target, whole, quota - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY d.src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below
  FROM d JOIN q ON d.src IS NOT DISTINCT FROM q.src
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, rest - below)))::BIGINT AS taken FROM b
"""
