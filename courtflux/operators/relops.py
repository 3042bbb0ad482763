"""Relational helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in names]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in an order; ``rank`` names their 0-based ranks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return (out.withColumn(rank, F.col("__r") - 1) if rank else out).drop("__r")


def first_seen(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The non-null value of each key that comes first in an order."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Pairs with ``right_at - left_at`` in [low, high], as an equi-join on buckets of that width.

    A left row goes to the one or two buckets that its interval touches, and a right row to its own, so no pair is made twice and no
    theta join runs over all pairs.
    """
    width = max(1, high - low + 1)
    lo, hi = F.floor((F.col(left_at) + low) / width), F.floor((F.col(left_at) + high) / width)
    spread = left.withColumn("__b", F.explode(F.sequence(lo, hi)))
    there = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns], F.floor(F.col(right_at) / width).alias("__rb"))
    cond = (F.col("__b") == F.col("__rb")) & (F.col(right_at) - F.col(left_at)).between(low, high)
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__r_{c}"))
    return spread.join(there, cond, how).drop("__b", "__rb", *(f"__r_{c}" for c in on))


def dyadic_nodes(a: Column, b: Column, levels: int) -> Column:
    """The nodes (level, node) of a binary tree over the integers that make up [a, b] exactly: at most two a level; node n of level l holds n * 2^l to (n + 1) * 2^l - 1.

    On a level the nodes that lie inside run from ``lo`` to ``hi``; those whose parents don't lie inside are ends of that run.
    """
    size = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level)
    lo = lambda level: F.floor((a + size(level) - 1) / size(level))
    hi = lambda level: F.floor((b + 1) / size(level)) - 1

    def of(level: Column) -> Column:
        ends = F.array_distinct(F.array(lo(level), hi(level)))
        some = F.filter(ends, lambda k: (lo(level) <= hi(level)) & ~F.floor(k / 2).between(lo(level + 1), hi(level + 1)))
        return F.transform(some, lambda k: F.struct(level.alias("level"), k.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def points_in_spans(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, a: str, b: str) -> DataFrame:
    """Pairs of a point and a span [a, b] (ends included) that holds it, for spans of any length, as an equi-join that makes each pair once.

    A span goes to the nodes that make it up and a point to the nodes above it, of which a span has exactly one: some 2 log2 of its length rows
    a span, and a row a point and level. Rows with a null in any of these columns, and spans that end before they begin, have no pairs.
    """
    longest = spans.agg(F.max(F.col(b) - F.col(a) + 1)).first()[0]
    levels = max(0, int(longest or 0).bit_length() - 1)
    spread = spans.where(F.col(a) <= F.col(b)).withColumn("__n", F.explode(dyadic_nodes(F.col(a), F.col(b), levels)))
    above = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.floor(F.col(at) / F.call_function("shiftleft", F.lit(1).cast("long"), level)).alias("node")))
    there = points.where(F.col(at).isNotNull()).withColumn("__n", F.explode(above))
    return there.join(spread, [*on, "__n"]).drop("__n")


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Pairs of spans of any length (ends included) that share a frame: of two such spans exactly one begins in the other, or both begin together.

    The sides have no column in common besides ``on``. Rows with nulls in keys or ends have no pairs.
    """
    l, r = left.where(F.col(a[0]) <= F.col(a[1])), right.where(F.col(b[0]) <= F.col(b[1]))
    late_right = points_in_spans(r, l, on, b[0], *a)
    late_left = points_in_spans(l, r, on, a[0], *b).where(F.col(a[0]) > F.col(b[0]))
    return late_right.unionByName(late_left)


def paired(left: DataFrame, right: DataFrame, key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on both tables' rows of each key, as one grouped map over their union.

    Not a cogroup: where both sides come from one table and not all output columns are asked for, Spark 4.1 prunes the right side's input.
    """
    own = left.columns, right.columns
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return run(*(rows.loc[rows["__side"] == i, c].reset_index(drop=True) for i, c in enumerate(own)))

    # Rows are few beside the work they make, so small partitions aren't merged.
    spread = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return spread.groupBy(key).applyInPandas(each, schema)


def islands(df: DataFrame, keys: Sequence[str], order: str, same: Column, name: str = "island") -> DataFrame:
    """Numbers maximal runs: a row begins a new one where ``same`` (of it and the row before) is not true."""
    w = Window.partitionBy(*keys).orderBy(order)
    begun = df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return begun.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def lagged(col: str, keys: Sequence[str], order: str) -> Column:
    return F.lag(col).over(Window.partitionBy(*keys).orderBy(order))


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, value: str, tolerance: int) -> DataFrame:
    """Each left row with the value of the nearest right row at or before it, at most ``tolerance`` back; else null."""
    key = [*on, at]
    near = band_join(left.select(*key).distinct(), right.select(*on, F.col(right_at).alias("__at"), F.col(value).alias("__v")), on, at, "__at", -tolerance, 0)
    best = near.groupBy(*key).agg(F.max_by(F.struct("__at", "__v"), "__at").alias("__x"))
    return left.join(best, key, "left").withColumn(value, F.col("__x.__v")).withColumn(right_at, F.col("__x.__at")).drop("__x")


def spine(meta: DataFrame, keys: Sequence[str], total: str, frame: str = "frame_id", step: int = 1) -> DataFrame:
    """A row for every frame 0 .. total-1."""
    return meta.where(F.col(total) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.lit(step).cast("long"))).alias(frame))
