"""Vectors in array columns, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a vector is null or nearly zero."""
    na, nb = norm(a), norm(b)
    return F.coalesce(F.when((na < 1e-8) | (nb < 1e-8), 1.0).otherwise(1 - dot(a, b) / (na * nb)), F.lit(1.0))


def gallery_distance(gallery: Column, query: Column) -> Column:
    """Least cosine distance to a gallery; 1 if it is empty."""
    return F.coalesce(F.array_min(F.transform(gallery, lambda g: cosine_distance(g, query))), F.lit(1.0))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def _by_place(rows: DataFrame, keys: list[str], value: str, unit: bool) -> DataFrame:
    """A row for each place of each vector."""
    own = F.col(value) if not unit else normalized(F.col(value))
    return rows.where(F.col(value).isNotNull()).select(*keys, F.posexplode(own).alias("__i", "__x")).withColumn("__x", F.col("__x").cast("double"))


def mean_of_units(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``mean``: the unit vector of the mean of each key's vectors at unit length. Sums are partial before the shuffle."""
    each = _by_place(rows, keys, value, True).groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__v"))
    return whole.select(*keys, normalized(F.transform("__v", lambda s: s["__m"])).alias("mean"))


def windowed_means(rows: DataFrame, keys: list[str], order: str, value: str, radius: int) -> DataFrame:
    """``mean`` of each row's vector and those of ``radius`` rows on both sides of it, and how many they are (``n``)."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    some = rows.where(F.col(value).isNotNull()).withColumn("__near", F.collect_list(value).over(near))  # at most 2 * radius + 1 vectors
    n = F.size("__near")
    total = F.aggregate(F.slice("__near", 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get("__near", F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return some.withColumn("mean", F.transform(total, lambda x: x / n)).withColumn("n", n.cast("long")).drop("__near")
