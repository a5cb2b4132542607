"""Vectors as arrays; sums are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def centroids(df: DataFrame, key: str, vector: str, unit: bool = True, pre_normalise: bool = False) -> DataFrame:
    """(key, centroid): element-wise means, summed map-side, by default brought to unit length."""
    v = normalise(F.col(vector)) if pre_normalise else F.col(vector)
    each = df.select(key, F.posexplode(v).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return whole.withColumn("centroid", normalise(F.col("centroid"))) if unit else whole
