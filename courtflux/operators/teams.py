"""Teams: pooled track vectors, two-means, and their evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship, written


def pooled(rows: DataFrame, value: str = "color", keys: tuple[str, ...] = ("video_id", "player_id")) -> DataFrame:
    """The component-wise median of each track's vectors, at unit length."""
    each = rows.where(F.col(value).isNotNull() & (F.col(keys[-1]) >= 0)).select(*keys, F.posexplode(value).alias("i", "x"))
    mid = each.groupBy(*keys, "i").agg(F.median("x").alias("m")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__v"))
    n = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return mid.withColumn("pooled", F.transform("__v", lambda x: F.when(n > 0, x / n).otherwise(x))).drop("__v")


def k_means(x: np.ndarray, k: int = 2, starts: int = 10, steps: int = 100, seed: int = 42) -> np.ndarray:
    """Labels of the best of several seeded runs (k-means++ starts); label 0 is the first row's."""
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        if d.min(1).sum() < best - 1e-12:
            best, labels = d.min(1).sum(), d.argmin(1)
    order = {v: i for i, v in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([order[v] for v in labels.tolist()])


def team_ids(rows: DataFrame, value: str = "color", teams: int = 2, keys: tuple[str, ...] = ("video_id", "player_id")) -> DataFrame:
    """A team for each track of a video; none if the video has fewer tracks than teams. A video has about ten tracks."""
    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys[-1])
        if len(pdf) < teams:
            return pd.DataFrame({keys[0]: [], keys[1]: [], "team_id": []})
        return pdf[list(keys)].assign(team_id=k_means(np.stack([np.asarray(v, float) for v in pdf.pooled]), teams))

    return pooled(rows, value, keys).groupBy(keys[0]).applyInPandas(run, f"{keys[0]} long, {keys[1]} long, team_id long")


def split_accuracy(rows: DataFrame, key: str) -> DataFrame:
    """Share of rows with the right team, under the better of both namings; rows without a prediction are wrong, labels beyond 0 and 1 don't count."""
    some = rows.where("gt in (0, 1)")
    direct, swapped = F.sum(F.when(F.col("pred") == F.col("gt"), 1).otherwise(0)), F.sum(F.when(F.col("pred") == 1 - F.col("gt"), 1).otherwise(0))
    return some.groupBy(key).agg(F.greatest(direct, swapped).alias("right"), F.count("*").alias("total")).withColumn("accuracy", F.col("right") / F.col("total"))


def sample_accuracy(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """``split_accuracy`` of the samples that have at least ``least`` tracks (column track_id)."""
    enough = rows.groupBy(key).agg(F.countDistinct("track_id").alias("__n")).where(F.col("__n") >= least).select(key)
    return split_accuracy(rows.join(enough, key, "left_semi"), key)


def track_vectors(rows: DataFrame, value: str, keys: tuple[str, ...] = ("video_id", "player_id")) -> DataFrame:
    """Each track's vectors and their frames, in frame order; untracked rows and null vectors don't count."""
    some = rows.where(F.col(value).isNotNull() & (F.col(keys[-1]) >= 0))
    got = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame_id", value))).alias("__v"))
    return got.select(*keys, F.transform("__v", lambda s: s["frame_id"]).alias("frames"), F.transform("__v", lambda s: s[value]).alias("vectors"))


def split_summary(each: DataFrame) -> DataFrame:
    """Micro accuracy, and mean and median over samples."""
    return each.agg((F.sum("right") / F.sum("total")).alias("micro"), F.avg("accuracy").alias("mean"), F.median("accuracy").alias("median"), F.count("*").alias("samples"))


def weighted_histogram(pixels: DataFrame, keys: list[str], value: str, weight: str, bins: int, top: float) -> DataFrame:
    """Weights by bin, as shares of each key's sum."""
    b = F.least(F.floor(F.col(value) * bins / top), F.lit(bins - 1))
    each = pixels.groupBy(*keys, b.alias("bin")).agg(F.sum(weight).alias("w"))
    return each.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))


def weighted_moments(pixels: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    w, x = F.col(weight), F.col(value)
    sums = pixels.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"))
    mean = F.col("s") / F.col("w")
    return sums.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))).alias("std"))


# -- distances of galleries ----------------------------------------------------------------------------------------------------


def least_distance(a: dict[int, np.ndarray], b: dict[int, np.ndarray], odd: bool) -> float:
    """The least cosine distance of two sets of unit vectors by their length; ``odd``: one of them also has some that are null or nearly zero."""
    near = [1.0] if odd or len(a.keys() | b.keys()) > 1 else []
    for k, x in a.items():
        if k in b:
            near += [float(1 - (x[i : i + 1024] @ b[k].T).max()) for i in range(0, len(x), 1024)]  # a part of the product at a time
    return min(near)


def _packed(rows: list) -> tuple[list[int], list[bytes], bool]:
    """Vectors by their length as bytes of doubles at unit length, and whether some are null or nearly zero, or have a null element."""
    sizes: dict[int, list] = {}
    for v in rows:
        sizes.setdefault(-1 if v is None else len(v), []).append(v)
    odd, out = bool(sizes.pop(-1, None)), {}
    for k, some in sizes.items():
        v = np.array(some, float)  # a null element is nan
        n = np.sqrt(np.einsum("ij,ij->i", v, v))
        good = np.isfinite(n) & (n >= 1e-8)
        odd |= not good.all()
        if good.any():
            out[k] = (v[good] / n[good, None]).tobytes()
    return list(out), list(out.values()), odd


def gallery_distances(vectors: DataFrame, block: int = 16384) -> DataFrame:
    """a, b, least: the least cosine distance of all vectors of two labels, for each a < b.

    A label's vectors are dealt into blocks of some ``block`` by the hash of their ids, packed once, and blocks are numbered; a pair of numbers
    fetches its two blocks by equal keys, and is one matrix product, taken in parts. The job is a product of the vectors by nature; blocks are
    sent once for each other block.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema["label"].dataType.simpleString()
    known = vectors.where("label is not null")
    counts = known.groupBy("label").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = known.join(counts, "label").select("label", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "embedding")

    def pack(t: pa.Table) -> pa.Table:
        rows = t.column("embedding").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        wide = set(pa.compute.list_value_length(rows).to_pylist())
        if len(wide) == 1 and None not in wide:
            v = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
            dims, data, odd = _packed(v) if v.shape[1] else _packed(rows.to_pylist())
        else:
            dims, data, odd = _packed(rows.to_pylist())
        return pa.table({"label": t.column("label")[:1], "part": t.column("part")[:1], "dims": pa.array([dims], pa.list_(pa.int32())), "data": pa.array([data], pa.list_(pa.binary())), "odd": pa.array([odd])})

    blocks = written(dealt.groupBy("label", "part").applyInArrow(pack, f"label {kind}, part long, dims array<int>, data array<binary>, odd boolean"))
    numbered = written(blocks.select("label", "part").withColumn("n", F.row_number().over(Window.orderBy("label", "part"))))  # a row a block
    last = numbered.count()
    pairs = numbered.where(F.col("n") < last).select(F.col("label").alias("a"), F.col("part").alias("pa"), F.explode(F.sequence(F.col("n") + 1, F.lit(last))).alias("nb"))
    pairs = pairs.join(numbered.select(F.col("n").alias("nb"), F.col("label").alias("b"), F.col("part").alias("pb")), "nb").where("a <> b")
    asked = pairs.select("a", "pa", "b", "pb", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("pa").alias("part")), F.struct(F.col("b").alias("label"), F.col("pb").alias("part")))).alias("own"))
    fetched = asked.select("a", "pa", "b", "pb", "own.label", "own.part").join(blocks, ["label", "part"])

    def product(t: pa.Table) -> pa.Table:
        sides = [{k: np.frombuffer(x, float).reshape(-1, k) for k, x in zip(t.column("dims")[i].as_py(), t.column("data")[i].as_py())} for i in range(2)]
        return pa.table({"a": t.column("a")[:1], "b": t.column("b")[:1], "least": pa.array([least_distance(*sides, any(t.column("odd").to_pylist()))])})

    return fetched.groupBy("a", "pa", "b", "pb").applyInArrow(product, f"a {kind}, b {kind}, least double").groupBy("a", "b").agg(F.min("least").alias("least"))
