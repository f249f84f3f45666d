"""Nearest-neighbour search: exact, by bucket, by region, by code.

Exact search is a product of blocks (:mod:`driftkeep.operators.blocks`), the
others are passes over the base (:mod:`driftkeep.operators.scans`), so pairs of
queries and items are never rows. Partial top-k by partition comes from the
window group limit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkeep.functions import hashing
from driftkeep.functions.vectors import dot
from driftkeep.operators import blocks, scans
from driftkeep.sources.staging import staged

def top_k(scored: DataFrame, k: int, by: str | list[str] = "query_id", score: str = "score", item: str = "item_id", ascending: bool = False) -> DataFrame:
    """rank 1 to k per query, ties to the smaller item."""
    order = [F.asc(score) if ascending else F.desc(score), F.asc(item)]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def exact(queries: DataFrame, base: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """query_id, item_id, score, rank for queries (query_id, q) and base (item_id, v)."""
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    return top_k(blocks.nearest(queries, base, k, metric), k)


def exact_unique(queries: DataFrame, base: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The k best distinct item ids, each by its best copy. The base is dealt by item, so copies meet without pairs being exchanged."""
    return top_k(scans.scan(queries, base, lambda asked, q: scans.Plain(asked, q, k, metric, unique=True), scans.FOUND, blocks.FOUND), k)


def within_groups(queries: DataFrame, base: DataFrame, k: int, group: str) -> DataFrame:
    """Top-k by inner product inside the query's own group (a conversation, a region)."""
    scored = queries.join(base, group).select(group, "query_id", "item_id", dot(F.col("q"), F.col("v")).alias("score"))
    return top_k(scored, k)


def spot_check(truth: DataFrame, again: DataFrame, k: int = 10) -> DataFrame:
    """query_id and the share of the first k stored neighbours that another search finds too."""
    both = truth.filter(F.col("rank") <= k).select("query_id", "item_id").join(again.filter(F.col("rank") <= k).select("query_id", "item_id"), ["query_id", "item_id"])
    asked = truth.select("query_id").distinct()
    return asked.join(both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("overlap"))


def hamming(queries: DataFrame, base: DataFrame, k: int, n_bits: int, dim: int, seed: int = 7) -> DataFrame:
    """Top-k by Hamming distance of hyperplane sign codes."""
    planes = hashing.hyperplanes(n_bits // 32, 32, dim, seed)
    return top_k(scans.scan(queries, base, lambda asked, q: scans.Signs(asked, q, k, planes), scans.FOUND, blocks.FOUND), k, ascending=True)


def probed(df: DataFrame, vector: str, dim: int, tables: int, rotations: int, seed: int, n_probes: int, keep: list[Column]) -> DataFrame:
    """One row per table and probed bucket, with the place in the table's probe order and the strength, the coordinate's magnitude."""
    buckets = hashing.probe_udf(dim, tables, rotations, seed, n_probes)(F.col(vector))
    return df.select(*keep, F.explode(buckets).alias("t")).select(*keep, "t.table", "t.bucket", "t.probe", "t.strength")


def thinned(base: DataFrame, dim: int, tables: int, rotations: int, seed: int, base_probes: int, bucket_cap: int, alpha: float) -> DataFrame:
    """item_id, table, bucket of an index whose buckets keep the ``bucket_cap`` items nearest to their axis, or the share ``alpha`` if that is more."""
    filed = probed(base, "v", dim, tables, rotations, seed, base_probes, [F.col("item_id")])
    bucket = Window.partitionBy("table", "bucket")
    filed = filed.withColumn("n", F.row_number().over(bucket.orderBy(F.desc("strength"), "item_id"))).withColumn("m", F.count(F.lit(1)).over(bucket))
    return filed.filter(F.col("n") <= F.greatest(F.lit(bucket_cap), F.ceil(F.col("m") * F.lit(alpha)))).select("item_id", "table", "bucket")


def probes_a_table(dim: int, tables: int, n_probes: int, total_probes: int | None) -> int:
    if total_probes is None:
        return n_probes
    if total_probes < tables:
        raise ValueError("a probe a table is the least")
    return min(total_probes - tables + 1, 2 * hashing.power_of_two(dim))


def multiprobe_candidates(queries: DataFrame, base: DataFrame, dim: int, tables: int = 16, n_probes: int = 64, base_probes: int = 1, rotations: int | None = None, seed: int = 42, bucket_cap: int | None = None, alpha: float = 0.01, total_probes: int | None = None) -> DataFrame:
    """Distinct (query_id, item_id) that share a probed bucket of cross-polytope tables.

    ``total_probes`` is a budget over all tables, at least one a table: each
    table's own bucket, then the strongest coordinates of any table. Without
    it every table has ``n_probes``. ``base_probes`` over 1 files each item
    under several buckets. ``bucket_cap`` thins such an index: a bucket keeps
    the items that lie nearest to its axis, ``bucket_cap`` of them or the share
    ``alpha`` if that is more; without it all stay, and the candidates are the
    whole buckets.
    """
    rotations = rotations or (2 if dim <= 128 else 1)
    filed = thinned(base, dim, tables, rotations, seed, base_probes, bucket_cap, alpha) if bucket_cap else probed(base, "v", dim, tables, rotations, seed, base_probes, [F.col("item_id")])
    n_probes = probes_a_table(dim, tables, n_probes, total_probes)
    asked = probed(queries, "q", dim, tables, rotations, seed, n_probes, [F.col("query_id")])
    if total_probes is not None:
        order = Window.partitionBy("query_id").orderBy(F.col("probe") > 0, F.desc("strength"), "table", "probe")
        asked = asked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= total_probes)
    return asked.select("query_id", "table", "bucket").join(filed.select("item_id", "table", "bucket"), ["table", "bucket"]).select("query_id", "item_id").distinct()


def by_buckets(queries: DataFrame, base: DataFrame, k: int, dim: int, first: str, metric: str, coder=None, tables: int = 16, n_probes: int = 64, base_probes: int = 1, rotations: int | None = None, seed: int = 42, bucket_cap: int | None = None, alpha: float = 0.01, total_probes: int | None = None) -> DataFrame:
    """query_id, item_id, score, more: the k best of ``multiprobe_candidates`` by the score ``first``, with the score ``metric`` as ``more``; pairs aren't rows.

    ``coder`` gives, from a matrix of vectors, what the first score compares in their place.
    """
    rotations = rotations or (2 if dim <= 128 else 1)
    n_probes, given = probes_a_table(dim, tables, n_probes, total_probes), {}
    if bucket_cap:
        width = 2 * hashing.power_of_two(dim)
        lists = thinned(base.filter("v is not null"), dim, tables, rotations, seed, base_probes, bucket_cap, alpha).groupBy("item_id").agg(F.collect_set((F.col("table") * width + F.col("bucket")).cast("long")).alias("filed"))
        base, given = base.join(lists, "item_id"), {"filed": F.col("filed")}

    def make(asked: np.ndarray, q: np.ndarray) -> scans.Scan:
        return scans.Probed(asked, q, k, scans.Buckets(asked, q, dim, tables, rotations, seed, n_probes, base_probes, total_probes), first, metric, coder)

    found = scans.scan(queries, base, make, [*scans.FOUND, "more"], f"{blocks.FOUND}, more double", given=given)
    return top_k(found, k).drop("rank")


def multiprobe(queries: DataFrame, base: DataFrame, k: int, dim: int, metric: str = "l2", rerank: int | None = None, **index) -> DataFrame:
    """Top-k among candidates; with ``rerank`` the best by inner product go to the exact score first."""
    if not rerank:
        return top_k(by_buckets(queries, base, k, dim, metric, metric, **index).select(*scans.FOUND), k)
    best = by_buckets(queries, base, rerank, dim, "ip", metric, **index)
    return top_k(best.select("query_id", "item_id", F.col("more").alias("score")), k)


def bucket_sweep(queries: DataFrame, base: DataFrame, k: int, dim: int, settings: list[tuple[int, int]], rotations: int = 2, seed: int = 42) -> DataFrame:
    """cell, query_id, item_id, rank of the k best bucket candidates by inner product under each setting (tables, probes a table); rows without a query have candidates in ``n``."""
    make = lambda asked, q: scans.Sweep(asked, q, k, settings, dim, rotations, seed)
    found = scans.scan(queries, base, make, scans.Sweep.NAMES, scans.Sweep.SCHEMA)
    return top_k(found.withColumns({c: F.when(F.col("n") == 0, F.col(c)) for c in ("query_id", "item_id", "score")}).withColumn("part", F.when(F.col("n") > 0, F.monotonically_increasing_id())), k, ["cell", "query_id", "part"]).drop("part")


def exact_by_cell(queries: DataFrame, base: DataFrame, k: int, cells: list[Column]) -> DataFrame:
    """cell, query_id, item_id, score, rank: the k best by inner product of each set of the base that a condition gives, in one pass."""
    if len(cells) > 62:
        raise ValueError("62 sets at most")
    mask = reduce(add, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cells)])
    n = len(cells)
    make = lambda asked, q: scans.Cells(asked, q, k, n)
    return top_k(scans.scan(queries, base, make, scans.Cells.NAMES, scans.Cells.SCHEMA, given={"mask": mask}), k, ["cell", "query_id"])


def routed(queries: DataFrame, base: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Top-k by inner product in the ``nprobe`` regions whose centroids (region, c) are nearest; base has ``region``."""
    reach = top_k(queries.join(F.broadcast(centroids)).select("query_id", "q", F.col("region").alias("item_id"), dot(F.col("q"), F.col("c")).alias("score")), nprobe)
    known = reach.groupBy("query_id", "q").agg(F.collect_set(F.col("item_id").cast("long")).alias("reach"))
    make = lambda asked, q, regions: scans.Routed(asked, q, regions, k)
    return top_k(scans.scan(known, base.filter("region is not null"), make, scans.FOUND, blocks.FOUND, {"reach": F.col("reach")}, {"region": F.col("region").cast("long")}), k)


def mean_centroids(base: DataFrame) -> DataFrame:
    """region and c: the mean vector of each region."""
    each = base.select("region", F.posexplode("v").alias("i", "x")).groupBy("region", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))


def fit_regions(base: DataFrame, k: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """Regions by k-means: base with ``region`` and the centroids, for data without labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = base.withColumn("features", array_to_vector("v"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(feats)
    return model.transform(feats).withColumn("region", F.col("prediction").cast("long")).drop("features", "prediction")


def pq_codebooks(base: DataFrame, parts: int, dim: int, codes: int, salt: int = 42) -> DataFrame:
    """m, code, w: subvectors of the ``codes`` items with the smallest hash, as a fixed codebook."""
    width = dim // parts
    chosen = base.withColumn("h", hashing.hash32("item_id", salt)).orderBy("h", "item_id").limit(codes)
    ranked = chosen.withColumn("code", F.row_number().over(Window.orderBy("h", "item_id")) - 1)  # at most ``codes`` rows
    return ranked.select(F.col("code").cast("long").alias("code"), F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.slice("v", m * width + 1, width).alias("w")) for m in range(parts)])).alias("p")).select("p.m", "code", "p.w")


def pq_search(queries: DataFrame, base: DataFrame, books: DataFrame, k: int) -> DataFrame:
    """Top-k by asymmetric squared distance: a lookup table per query, summed over the nearest codeword of each part."""
    rows = sorted(books.collect(), key=lambda r: (r.m, r.code))  # parts times codes
    parts = len({r.m for r in rows})
    trained = np.array([r.w for r in rows]).reshape(parts, len(rows) // max(1, parts), -1) if rows else None
    found = scans.scan(queries, base, lambda asked, q: scans.Coded(asked, q, k, trained), scans.FOUND, blocks.FOUND)
    return top_k(found, k, ascending=True)


def signature_pairs(df: DataFrame, tables: int, at_least: float) -> DataFrame:
    """a, b, n_a, n_b, jaccard of signatures that share buckets: m equal tables give m / (2 * tables - m).

    Items of one signature are a class, named by its smallest pos and with its
    size, so pairs are bounded by the signatures there are and not by items.
    Where one equal table isn't enough, classes meet by two, so that those of a
    key differ in all the other tables.
    """
    least = next((m for m in range(1, tables + 1) if m / (2 * tables - m) >= at_least), tables + 1)
    if least > tables:
        least = tables  # no pair can do
    classes = staged(df.groupBy("sig").agg(F.min("pos").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    shared = list(combinations(range(tables), min(2, least)))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.get("sig", t) for t in ts]).alias("bs")) for i, ts in enumerate(shared)])
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), *[F.get("sig", t).alias(f"{x}{t}") for t in range(tables)], F.explode(keys).alias("key")).select("*", "key.i", "key.bs").drop("key")
    parts = max(1, -(-classes.count() * len(shared) // 4000))
    left, right = (side(x).repartition(parts, "i", "bs") for x in ("a", "b"))
    same = lambda t: F.coalesce(F.col(f"a{t}") == F.col(f"b{t}"), F.lit(False))
    # A pair is made by the first tables that it shares, and by no others.
    made_by = F.lit(None).cast("int")
    for i, ts in reversed(list(enumerate(shared))):
        made_by = F.when(reduce(and_, [same(t) for t in ts]), F.lit(i)).otherwise(made_by)
    m = reduce(add, [same(t).cast("long") for t in range(tables)])
    met = left.join(right.hint("merge"), ["i", "bs"]).filter(F.col("a") < F.col("b")).filter(F.col("i") == made_by)
    return met.select("a", "b", "n_a", "n_b", (m / (2 * tables - m)).alias("jaccard")).filter(F.col("jaccard") >= at_least)


def signature_classes(df: DataFrame) -> DataFrame:
    """pos and rep, the smallest pos of its signature."""
    return df.select("pos", "sig").join(df.groupBy("sig").agg(F.min("pos").alias("rep")), "sig").select("pos", "rep")
