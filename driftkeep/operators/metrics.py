"""Recall, coverage, diversity, latency and memory of a kept set, each as one small DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkeep.functions.hashing import hash32
from driftkeep.functions.vectors import l2_squared
from driftkeep.operators import blocks
from driftkeep.operators.streams import positions


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, recall: found within the true first k, over k; queries without a hit count as 0."""
    t = truth.filter(F.col("rank") <= k).select("query_id", "item_id")
    hits = t.join(found.filter(F.col("rank") <= k).select("query_id", "item_id").distinct(), ["query_id", "item_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def distribution(values: DataFrame, column: str = "recall") -> DataFrame:
    p = lambda x: F.percentile(column, F.lit(x))
    return values.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.avg((F.col(column) == 0).cast("double")).alias("zero_frac"))


def coverage(truth: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """Distinct true items within k that are kept, over all distinct true items."""
    t = truth.filter(F.col("rank") <= k).select("item_id").distinct()
    marked = t.join(kept.select("item_id").distinct().withColumn("in", F.lit(1)), "item_id", "left")
    return marked.agg(F.coalesce(F.sum("in") / F.count(F.lit(1)), F.lit(0.0)).alias("coverage"))


def quantiles(df: DataFrame, value: Column, at: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, None without values: values are numbered by a distributed sort and two are picked for each, so no task holds them all."""
    ranked = positions(df.select(value.cast("double").alias("x")).filter("x is not null"), F.col("x"))
    n = ranked.count()
    if not n:
        return [None] * len(at)
    places = {int(p * (n - 1)) + i for p in at for i in (0, 1)}
    x = {r.pos: r.x for r in ranked.filter(F.col("pos").isin(list(places))).collect()}
    low = [int(p * (n - 1)) for p in at]
    return [x[i] + (x.get(i + 1, x[i]) - x[i]) * (p * (n - 1) - i) for p, i in zip(at, low, strict=True)]


def latency(df: DataFrame, nanoseconds: str) -> DataFrame:
    """Microseconds: mean, percentiles, maximum and the ratio of p99 to p50."""
    us = F.col(nanoseconds) / 1000.0
    at = {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99, "p999_us": 0.999}
    found = dict(zip(at, quantiles(df, us, list(at.values())), strict=True))
    out = df.agg(F.avg(us).alias("mean_us"), F.max(us).alias("max_us")).select("mean_us", *[F.lit(v).cast("double").alias(k) for k, v in found.items()], "max_us")
    return out.withColumn("tail_ratio", F.col("p99_us") / F.when(F.col("p50_us") != 0, F.col("p50_us")))


def cluster_coverage(kept: DataFrame, n_clusters: int) -> DataFrame:
    """Distinct labels kept, their share, and the natural-log entropy of the label counts."""
    n = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return n.join(F.broadcast(all_)).agg(F.count(F.lit(1)).alias("n_covered"), (F.count(F.lit(1)) / F.lit(float(n_clusters))).alias("fraction"), F.coalesce(F.sum(-p * F.log(p)), F.lit(0.0)).alias("entropy"))


#: Items that a radius or redundancy of a stream is measured at, and of a kept set that its spread is, at most; pairs for the largest distance.
STREAM_SAMPLE, KEPT_SAMPLE, PAIRS = 50_000, 5_000, 1_000


def hash_sample(items: DataFrame, n: int, salt: int = 42) -> DataFrame:
    """The n items of the smallest seeded hash: a uniform sample that any engine draws alike; all items if there are no more."""
    return items.orderBy(hash32("item_id", salt), "item_id").limit(n)


def nearest(probe: DataFrame, kept: DataFrame, metric: str, others: bool = False) -> DataFrame:
    """The best score of each probed item (item_id, v) among the kept ones (item_id, v)."""
    asked = probe.select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return blocks.nearest(asked, kept, 1, metric, others).groupBy("query_id").agg(F.max("score").alias("best"))


def k_center_radius(stream: DataFrame, kept: DataFrame, sample: int = STREAM_SAMPLE) -> DataFrame:
    """Largest distance from a sampled item of the stream to its nearest kept one; infinite if nothing is kept."""
    far = nearest(hash_sample(stream, sample), kept, "l2")
    return far.agg(F.coalesce(F.sqrt(-F.min("best")), F.lit(float("inf"))).alias("radius"))


def cosine_radius(stream: DataFrame, kept: DataFrame, sample: int = STREAM_SAMPLE) -> DataFrame:
    """1 - the smallest best cosine of a sampled unit vector of the stream; 2 if nothing is kept."""
    return nearest(hash_sample(stream, sample), kept, "ip").agg(F.coalesce(1 - F.min("best"), F.lit(2.0)).alias("cosine_radius"))


def intra_distance(items: DataFrame, sample: int = KEPT_SAMPLE) -> DataFrame:
    """Mean distance of a sampled item to the nearest other of the sample; 0 for fewer than two."""
    few = hash_sample(items, sample)
    return nearest(few, few, "l2", others=True).agg(F.coalesce(F.avg(F.sqrt(-F.col("best"))), F.lit(0.0)).alias("mean_nn_distance"))


def cosine_stats(items: DataFrame, sample: int = KEPT_SAMPLE) -> DataFrame:
    """Mean, largest and p90 cosine of a sampled unit vector to the nearest other of the sample, and 1 - the mean."""
    few = hash_sample(items, sample)
    near = nearest(few, few, "ip", others=True)
    return near.agg(F.avg("best").alias("mean_nn_cosine"), F.max("best").alias("max_nn_cosine"), F.percentile("best", F.lit(0.9)).alias("p90_nn_cosine"), (1 - F.avg("best")).alias("diversity"))


def stream_redundancy(items: DataFrame, sample: int = STREAM_SAMPLE, pairs: int = PAIRS, salt: int = 42) -> DataFrame:
    """1 - mean distance to the nearest other / largest distance of random pairs, within a sample; ids are unique."""
    few = hash_sample(items, sample, salt)
    # At most ``sample`` rows are numbered.
    listed = few.withColumn("i", F.row_number().over(Window.orderBy(hash32("item_id", salt), "item_id")) - 1)
    n = few.agg(F.count(F.lit(1)).alias("n"))
    drawn = items.sparkSession.range(pairs).join(F.broadcast(n)).select(F.pmod(hash32("id", salt + 1), "n").alias("a"), F.pmod(hash32("id", salt + 2), "n").alias("b"))
    left, right = listed.select(F.col("i").alias("a"), F.col("v").alias("va")), listed.select(F.col("i").alias("b"), F.col("v").alias("vb"))
    far = drawn.join(left, "a").join(right, "b").agg(F.max(F.sqrt(l2_squared(F.col("va"), F.col("vb")))).alias("far"))
    return intra_distance(items, sample).join(F.broadcast(far)).select((1 - F.col("mean_nn_distance") / F.col("far")).alias("redundancy"))


def memory_footprint(n: Column, dim: int, tables: int, bits: int) -> list[Column]:
    """Megabytes of vectors, signatures and counters, their sum, and the share that isn't vectors."""
    vectors, signatures, counters = n * float(dim * 4), n * (tables * bits / 8.0), F.lit(float(tables * (1 << bits) * 4))
    all_ = vectors + signatures + counters
    return [(vectors / 1e6).alias("vectors_mb"), (signatures / 1e6).alias("signatures_mb"), (counters / 1e6).alias("counters_mb"), (all_ / 1e6).alias("total_mb"), ((signatures + counters) / all_).alias("overhead")]


def distance_ratio(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Mean ratio of the first found distance (1 - score) to the first true one, guarded near zero."""
    first = lambda df, n: df.filter("rank = 1").select("query_id", (1 - F.col("score")).alias(n))
    both = first(truth, "t").join(first(found, "f"), "query_id")
    ratio = F.when(F.col("t") >= 1e-6, F.col("f") / F.col("t")).when(F.col("f") < 1e-6, 1.0).otherwise(10.0)
    return both.agg(F.avg(ratio).alias("distance_ratio"))


def answer_score(prediction: Column, answer: Column) -> Column:
    """1 if either text, trimmed and lower-cased, holds the other; an empty prediction scores 0."""
    p, a = F.lower(F.trim(prediction)), F.lower(F.trim(answer))
    return F.when((F.coalesce(F.length(p), F.lit(0)) > 0) & (p.contains(a) | a.contains(p)), 1.0).otherwise(0.0)


def confusion_rates() -> list[Column]:
    """Rates from tp, fp, fn, tn, filter_stored and n_stream."""
    c = lambda a, *b: (F.col(a) / F.when(sum((F.col(x) for x in b), F.lit(0)) != 0, sum((F.col(x) for x in b), F.lit(0))))
    return [c("tp", "tp", "fp").alias("precision"), c("tp", "tp", "fn").alias("recall"), c("filter_stored", "n_stream").alias("compression"), c("fp", "fp", "tn").alias("false_admit_rate"), c("fn", "fn", "tp").alias("false_reject_rate")]
