"""Streams made from a set of vectors: pos, item_id, v and what generated them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkeep.functions.hashing import hash32
from driftkeep.functions.vectors import normalized, project
from driftkeep.sources.staging import staged


def positions(df: DataFrame, *order) -> DataFrame:
    """pos from 0 in a given order: ranges sorted apart, then shifted by the rows before them.

    The sorted ranges and the place of each row in its range are written once
    and read back: range bounds are sampled and partitions merged at run time,
    so a plan that sorted twice could number one sort and count another. Equal
    rows in the order keep the place they were written in.
    """
    ranged = df.select("*").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    numbered = staged(ranged, "positions").withColumn("__p", F.shiftright("__m", 33))
    counts = numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition of the sort, so the window is small.
    starts = counts.withColumn("__s", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    joined = numbered.join(F.broadcast(starts), "__p")
    return joined.withColumn("pos", F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__s")


def first_in_order(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by ascending keys that no two rows share: the n-th key is found by numbering the keys alone, then rows are filtered.

    Keys aren't null. Nothing is gathered in one task, however large ``n`` is.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    named = df.select(*[c.alias(k) for c, k in zip(order, keys, strict=True)])
    last = positions(named, *[F.col(k) for k in keys]).filter(F.col("pos") == n - 1).select(F.struct(*keys).alias("k")).first()
    if last is None:
        return df
    kinds = dict(named.dtypes)
    return df.filter(F.struct(*[c.alias(k) for c, k in zip(order, keys, strict=True)]) <= F.struct(*[F.lit(last.k[k]).cast(kinds[k]).alias(k) for k in keys]))


def clean(base: DataFrame, salt: int = 43) -> DataFrame:
    return positions(base, hash32("item_id", salt).alias("__h"), F.col("item_id"))


def with_duplicates(base: DataFrame, rate: float, salt: int = 42) -> DataFrame:
    """int(n * rate / (1 - rate)) copies of sources drawn with replacement, then one shuffle; a copy keeps its source's id."""
    n = base.count()
    extra = int(n * rate / (1 - rate))
    indexed = positions(base, F.col("item_id")).withColumnRenamed("pos", "src")
    draws = base.sparkSession.range(extra).select(F.col("id").alias("draw"), F.pmod(hash32("id", salt), F.lit(n)).alias("src"))
    copies = draws.join(indexed, "src").select("item_id", "v", "label", F.lit(True).alias("is_dup"), (F.col("draw") + n).alias("seq"))
    all_ = indexed.select("item_id", "v", "label", F.lit(False).alias("is_dup"), F.col("src").alias("seq")).unionByName(copies)
    return positions(all_, hash32("seq", salt + 1).alias("__h"), F.col("seq")).drop("seq")


def drift(base: DataFrame) -> DataFrame:
    """Topic after topic: a stable sort by label."""
    return positions(base, F.col("label"), F.col("item_id"))


def boundaries(stream: DataFrame) -> DataFrame:
    return stream.groupBy("label").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def query_sample(base: DataFrame, n: int, salt: int = 42) -> DataFrame:
    """query_id and q of the n items with the smallest hash; n is what one task can hold."""
    return base.orderBy(hash32("item_id", salt), "item_id").limit(n).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


def centred(base: DataFrame, *others: DataFrame) -> DataFrame:
    """The base minus its mean in each dimension."""
    means = base.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    # One row per dimension.
    row = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("__mean"))
    return base.join(F.broadcast(row)).withColumn("v", F.zip_with("v", "__mean", lambda x, m: x - m)).drop("__mean")


def jl_matrix(dim: int, to: int, seed: int = 42) -> np.ndarray:
    return np.random.RandomState(seed).randn(to, dim) / np.sqrt(to)


def jl_projected(base: DataFrame, dim: int, to: int, seed: int = 42) -> DataFrame:
    """A Gaussian projection to ``to`` dimensions, normalised again."""
    return base.withColumn("v", project(jl_matrix(dim, to, seed), F.col("v"))).withColumn("v", normalized(F.col("v")))


def equal_footprint(n: int, fractions: list[float], dims: list[int], full: int) -> list[tuple[float, int, int]]:
    """(fraction, dim, capacity): as many bytes as the full dimension's capacity takes."""
    return [(f, d, int(max(int(n * f), 5) * full / d)) for f in fractions for d in dims]
