"""Numbering and cutting of streams that lie in many partitions."""

import pytest
from pyspark.sql import functions as F

from driftkeep.operators import knn, pq, policies, registry, streams


@pytest.fixture
def wide(spark):
    """400,000 rows of 48 doubles, some 150 MB."""
    v = F.array(*[F.rand(i) for i in range(48)])
    yield spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("item_id"), v.alias("v"))


@pytest.fixture
def settings(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(n) for n in names]
    yield lambda *values: [spark.conf.set(n, v) for n, v in zip(names, values, strict=True)]
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("partitions", ["8", "200"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_number_every_row(wide, settings, partitions, adaptive):
    settings(partitions, adaptive)
    got = streams.positions(wide, F.col("item_id"))
    n, different, wrong = got.agg(F.count("v"), F.countDistinct("pos"), F.sum((F.col("pos") != F.col("item_id")).cast("long"))).first()
    assert (n, different, wrong) == (400_000, 400_000, 0)


def test_cuts_of_large_streams(spark, settings):
    settings("16", "true")
    df = spark.range(0, 300_000, 1, 24).select((F.col("id") * 3).alias("pos"), F.col("id").alias("item_id"))
    n, least = policies.fifo(df, 120_000).agg(F.count("pos"), F.min("pos")).first()
    assert (n, least) == (120_000, 3 * 180_000)
    assert policies.reservoir(df, 120_000).agg(F.count("pos"), F.countDistinct("pos")).first() == (120_000, 120_000)
    scored = df.withColumn("s", F.when(F.col("item_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("item_id") % 7))
    best = policies.freshness(scored, 1000, F.col("s")).agg(F.min("s"), F.min("pos"), F.count("pos")).first()
    assert best[0] == 6.0 and best[2] == 1000 and best[1] > 3 * 280_000


def test_every_policy_sees_every_row(spark):
    df = streams.positions(spark.range(500).select(F.col("id").alias("item_id"), F.array(F.cos("id"), F.sin("id")).alias("v")), F.col("item_id")).withColumn("key", F.lit(0).cast("long")).withColumn("sig", F.array(F.col("pos") % 3, F.col("pos") % 5))
    sizes = {name: registry.policy(name)(df, 50).count() for name in registry.names() if name != "bernoulli"}
    assert sizes == {"oracle": 500, "fifo": 50, "freshness": 50, "reservoir": 50, "bucket_occupancy": 50, "semantic_dedup": sizes["semantic_dedup"], "reservoir_r": 50}
    assert 0 < sizes["semantic_dedup"] <= 50 and 0 < registry.policy("bernoulli")(df, 50, stream_size=500).count() < 120
    with pytest.raises(ValueError):
        registry.policy("none")
    with pytest.raises(ValueError):
        registry.register("fifo")(policies.fifo)


@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_block_search_is_exact(spark, monkeypatch, limit, metric):
    import numpy as np

    from driftkeep.operators import blocks

    monkeypatch.setattr(blocks, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(blocks, "GROUP_ROWS", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)).round(1)
    x[200:] = x[:100]  # ties
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "item_id long, v array<double>").repartition(5)
    q = base.filter("item_id % 7 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    got = {(r.query_id, r["rank"]): r.item_id for r in knn.exact(q, base, 6, metric).collect()}
    for i in range(0, 300, 7):
        s = {"ip": lambda a, b: (a * b).sum(1), "l2": lambda a, b: -((a - b) ** 2).sum(1), "cosine": lambda a, b: (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))}[metric](np.repeat(x[i : i + 1], 300, 0), x)
        want = np.lexsort((np.arange(300), -s))[:6]
        assert [got[i, r + 1] for r in range(6)] == want.tolist()


def test_trained_codes_find_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 2000)] + 0.4 * rng.normal(size=(2000, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    q = base.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    books = pq.fit_codebooks(base, parts=8, codes=32, sample=1000)
    assert books.shape == (8, 32, 4)
    found = pq.search(q, base, books, 10, 32, tables=8, n_probes=24).select("query_id", "item_id")
    truth = knn.exact(q, base, 10, "l2").select("query_id", "item_id")
    assert found.intersect(truth).count() >= 0.9 * truth.count()


def test_thinned_buckets_keep_what_is_nearest_to_the_axis(spark):
    rows = [(i, [1.0 + i, 0.5, 0.0, 0.0]) for i in range(40)]
    base = spark.createDataFrame(rows, "item_id long, v array<double>")
    q = base.limit(1).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    all_ = knn.multiprobe_candidates(q, base, 4, tables=1, n_probes=4).count()
    few = {r.item_id for r in knn.multiprobe_candidates(q, base, 4, tables=1, n_probes=4, bucket_cap=3, alpha=0.0).collect()}
    assert all_ == 40 and 39 in few and len(few) <= 12
    assert knn.multiprobe_candidates(q, base, 4, tables=1, n_probes=4, bucket_cap=3, alpha=1.0).count() == 40
    with pytest.raises(ValueError):
        knn.multiprobe_candidates(q, base, 4, tables=4, total_probes=3)
