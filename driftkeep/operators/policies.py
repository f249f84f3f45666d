"""Retention policies: which B items of a stream to keep.

Policies without state are filters and windows. The others share one
state machine per stream (:mod:`driftkeep.operators.machines`), fed row by row from a
partition sorted by (key, pos): a task holds one stream's B kept entries and
one Arrow batch, however long the stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkeep.functions.hashing import hash01, hash32
from driftkeep.operators import machines
from driftkeep.operators.streams import first_in_order

LOG = "pos long, item_id long, accepted boolean, occ double, evicted long"


def _budget(df: DataFrame, capacity: int) -> None:
    if capacity < 1:
        raise ValueError("capacity must be at least 1")


def keep_all(df: DataFrame) -> DataFrame:
    return df


def _first(df: DataFrame, capacity: int, *order: Column, key: str | None = None) -> DataFrame:
    """The first B rows by ascending keys: a filter at the B-th key for one stream, a ranked window per key for many."""
    _budget(df, capacity)
    if key is None:
        return first_in_order(df, capacity, *order)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__rank") <= capacity).drop("__rank")


def fifo(df: DataFrame, capacity: int, key: str | None = None) -> DataFrame:
    """The most recent B items."""
    return _first(df, capacity, -F.col("pos"), key=key)


def freshness(df: DataFrame, capacity: int, score: Column | None = None, key: str | None = None) -> DataFrame:
    """Highest score first, a null score last; by default the age alone, which ranks as exp(-decay * age) does without underflow."""
    by_score = [] if score is None else [F.coalesce(-score, F.lit(float("inf")))]
    return _first(df, capacity, *by_score, -F.col("pos"), key=key)


def reservoir(df: DataFrame, capacity: int, salt: int = 42, key: str | None = None) -> DataFrame:
    """A uniform sample of B items without replacement: the smallest seeded hashes."""
    return _first(df, capacity, hash32("pos", salt), F.col("pos"), key=key)


def bernoulli(df: DataFrame, capacity: int, stream_size: int | None = None, salt: int = 42) -> DataFrame:
    """Each item with probability B/N, N being counted if it isn't given; the count only tends to B."""
    stream_size = df.count() if stream_size is None else stream_size
    return df.filter(hash01("pos", salt) < F.lit(capacity / stream_size))


def fill_occupancy(df: DataFrame, tables: int, key: str | None = None) -> DataFrame:
    """occ_min, occ_max, occ_mean, occ_median of the earlier items in an item's buckets while nothing is evicted."""
    keys = [key] if key else []
    each = df.select("pos", *keys, F.posexplode("sig").alias("t", "bucket"))
    before = Window.partitionBy(*keys, "t", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.withColumn("n", F.count(F.lit(1)).over(before).cast("double"))
    return counts.groupBy("pos", *keys).agg(F.min("n").alias("occ_min"), F.max("n").alias("occ_max"), F.avg("n").alias("occ_mean"), F.median("n").alias("occ_median"))


def run_machine(df: DataFrame, make: Callable[[object], machines.Machine], payload: str, key: str) -> DataFrame:
    """The decision log of one state machine per key, which ``make`` makes for the key, in order of pos."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current = None, None
        for pdf in batches:
            out = []
            for k, pos, item, x in zip(pdf[key].tolist(), pdf.pos.tolist(), pdf.item_id.tolist(), pdf[payload], strict=True):
                if machine is None or k != current:
                    machine, current = make(k), k
                out.append((k, pos, item, *machine.offer(pos, item, x)))
            yield pd.DataFrame(out, columns=[key, "pos", "item_id", "accepted", "occ", "evicted"]).astype({"evicted": "Int64"})

    ordered = df.select(key, "pos", "item_id", payload).repartition(key).sortWithinPartitions(key, "pos")
    return ordered.mapInPandas(run, f"{key} {kind}, {LOG}")


def bucket_occupancy(df: DataFrame, capacity: int, aggregator: str = "median", threshold: float | None = None, key: str = "key", id_mode: str = "pos") -> DataFrame:
    """Decision log of the bucket-occupancy policy over a column ``sig`` of buckets."""
    _budget(df, capacity)
    machines.check_aggregator(aggregator)
    return run_machine(df, lambda _: machines.BucketOccupancy(capacity, aggregator, threshold, id_mode), "sig", key)


def semantic_dedup(df: DataFrame, capacity: int, epsilon: float = 0.1, key: str = "key") -> DataFrame:
    """Decision log of greedy deduplication over unit vectors ``v``: reject above similarity 1 - epsilon."""
    _budget(df, capacity)
    return run_machine(df, lambda _: machines.SemanticDedup(capacity, epsilon), "v", key)


def occupancy_grid(df: DataFrame, cells: list[tuple[str, int, float | None]], key: str = "key") -> DataFrame:
    """Decision logs of bucket occupancy for every cell (aggregator, capacity, threshold) of a grid, in one exchange: ``cell`` is its place in the list."""
    for aggregator, capacity, _ in cells:
        _budget(df, capacity)
        machines.check_aggregator(aggregator)
    each = df.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1)))).withColumn("stream", F.concat_ws("|", "cell", key))

    def make(stream: str) -> machines.Machine:
        aggregator, capacity, threshold = cells[int(stream.split("|", 1)[0])]
        return machines.BucketOccupancy(capacity, aggregator, threshold)

    log = run_machine(each, make, "sig", "stream")
    return log.withColumn("cell", F.split("stream", r"\|")[0].cast("int"))


def reservoir_r(df: DataFrame, capacity: int, seed: int = 42, key: str = "key") -> DataFrame:
    """Decision log of the classic replacement reservoir with a seeded generator per stream."""
    _budget(df, capacity)
    return run_machine(df.withColumn("payload", F.lit(0)), lambda _: machines.ReplacingReservoir(capacity, seed), "payload", key)


def kept(log: DataFrame, key: str = "key") -> DataFrame:
    """Accepted and not evicted later: key, pos, item_id."""
    gone = log.filter(F.col("evicted").isNotNull()).select(F.col(key).alias("__key"), F.col("evicted").alias("__pos"))
    return log.filter("accepted").select(key, "pos", "item_id").join(gone, (F.col(key) == F.col("__key")) & (F.col("pos") == F.col("__pos")), "left_anti")


def stats(log: DataFrame, signatures: DataFrame, key: str = "key") -> DataFrame:
    """seen, kept, discarded, retention rate of acceptance, active buckets, mean and largest occupancy per stream."""
    seen = log.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("accepted").cast("long")).alias("accepted"))
    left = kept(log, key)
    buckets = left.join(signatures.select(key, "pos", "sig"), [key, "pos"]).select(key, F.posexplode("sig").alias("t", "b")).groupBy(key, "t", "b").agg(F.count(F.lit(1)).alias("n"))
    occupancy = buckets.groupBy(key).agg(F.count(F.lit(1)).alias("active_buckets"), F.avg("n").alias("mean_occupancy"), F.max("n").alias("max_occupancy"))
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("kept"))
    out = seen.join(sizes, key, "left").join(occupancy, key, "left").fillna(0)
    return out.select(key, "seen", "kept", (F.col("seen") - F.col("accepted")).alias("discarded"), (F.col("accepted") / F.greatest("seen", F.lit(1))).alias("retention_rate"), "active_buckets", "mean_occupancy", "max_occupancy")
