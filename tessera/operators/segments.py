"""Gaps, blocks, streaks and samples over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import micros, whole_days


def time_blocks(df: DataFrame, key: str, ts: str, tie: str, gap: Column | int, unit: str = "day") -> DataFrame:
    """Adds ``block``, 0 for a group's first; a new one starts where the full-unit gap to the row before exceeds ``gap``."""
    w = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_first(), F.col(tie).asc())
    return df.withColumn("_new", F.coalesce((_gap(F.lag(ts).over(w), F.col(ts), unit) > gap).cast("int"), F.lit(0))).withColumn(
        "block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    ).drop("_new")


def _gap(a: Column, b: Column, unit: str) -> Column:
    return whole_days(a, b) if unit == "day" else F.floor((micros(b) - micros(a)) / {"hour": 3_600_000_000}[unit])


def active_streak(df: DataFrame, key: str, ts: str, tie: str, gap: int, unit: str = "day") -> DataFrame:
    """Rows of each group from the newest back to the first gap over ``gap``."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc())
    broken = F.coalesce((_gap(F.col(ts), F.lag(ts).over(w), unit) > gap).cast("int"), F.lit(0))
    return df.withColumn("_cut", broken).withColumn("_cuts", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cuts = 0").drop("_cut", "_cuts")


def newest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_block(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_last", F.max("block").over(Window.partitionBy(key))).where("block = _last").drop("_last")


def sample_thirds(df: DataFrame, key: str, order: list[Column], each: int) -> DataFrame:
    """The first, middle and last ``each`` rows of a group; groups of up to three times as many stay whole."""
    w, part = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(part))
    middle = F.floor(F.col("_n") / 2) - each // 2
    inside = (F.col("_n") <= 3 * each) | (F.col("_i") <= each) | (F.col("_i") > F.col("_n") - each) | ((F.col("_i") > middle) & (F.col("_i") <= middle + each))
    return df.where(inside).drop("_i", "_n")


def sample_halves(df: DataFrame, key: str, order: list[Column], each: int) -> DataFrame:
    w, part = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(part))
    return df.where((F.col("_i") <= each) | (F.col("_i") > F.col("_n") - each)).drop("_i", "_n")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rank"
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return df if rank else df.drop(name)


def seeded_sample(df: DataFrame, keys: list[str], row: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each group (of all without keys), the same in every run: the first by the MD5 of ``seed:row``."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))
    return top_n(df, keys, [place, F.col(row)], n) if keys else df.orderBy(place, row).limit(n)


def runs(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their group."""
    w = Window.partitionBy(key).orderBy(*order)
    same, first = F.col(value).eqNullSafe(F.lag(value).over(w)), F.row_number().over(w) == 1
    return df.withColumn("_start", first | ~same).where("_start").drop("_start")


def in_episodes(mails: DataFrame, episodes: DataFrame, key: str, day: str) -> DataFrame:
    """Rows of each episode (key, d_from, d_to) whose day lies in it; a row may lie in several. The key bounds the join."""
    return mails.join(episodes, key).where((F.col(day) >= F.col("d_from")) & (F.col(day) <= F.col("d_to")))


def overlapping(episodes: DataFrame, key: str, number: str) -> DataFrame:
    a, b = episodes.alias("a"), episodes.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    return both.where((F.col(f"a.{number}") < F.col(f"b.{number}")) & (F.col("a.d_from") <= F.col("b.d_to")) & (F.col("b.d_from") <= F.col("a.d_to"))).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{number}").alias("first"), F.col(f"b.{number}").alias("second")
    )
