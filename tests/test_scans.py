"""Searches that pass over the base once: exact results, and no table of pairs of queries and items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkeep.operators import knn, scans


@pytest.fixture(params=["broadcast", "tiles"])
def way(request, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 37)  # blocks end within copies and ties
    if request.param == "tiles":
        monkeypatch.setattr(scans, "QUERY_ROWS", 7)
        monkeypatch.setattr(scans, "GROUP_ROWS", 90)


@pytest.fixture
def vectors(spark):
    """300 vectors of 8 with copies, which tie, every 11th a query."""
    x = np.random.default_rng(5).normal(size=(300, 8))
    x[200:] = x[:100]
    base = spark.createDataFrame([(i, v.tolist(), i % 6) for i, v in enumerate(x)] + [(900, None, 1)], "item_id long, v array<double>, region long").repartition(5)
    return x, base, base.filter("item_id % 11 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


def rows(df, names=("query_id", "rank", "item_id")):
    return {tuple(r[n] for n in names) for r in df.collect()}


def best(score, k, allowed=None):
    """query place, rank, item id of a matrix of scores, queries by items."""
    out = set()
    for i, s in enumerate(score):
        ids = np.arange(len(s)) if allowed is None else np.flatnonzero(allowed[i])
        out |= {(11 * i, r + 1, int(ids[j])) for r, j in enumerate(np.lexsort((ids, -s[ids]))[:k])}
    return out


def paired(df):
    """Joins and rows made of others in a plan: a search that pairs rows has some."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(x) for x in ("Join", "Generate", "CartesianProduct"))


def test_product_codes(spark, vectors, way):
    x, base, q = vectors
    books = knn.pq_codebooks(base.filter("v is not null"), 4, 8, 6)
    w = np.zeros((4, 6, 2))
    for r in books.collect():
        w[r.m, r.code] = r.w
    codes = np.stack([((x[:, 2 * m : 2 * m + 2][:, None] - w[m]) ** 2).sum(2).argmin(1) for m in range(4)], 1)
    far = sum(((x[::11, 2 * m : 2 * m + 2][:, None] - w[m][codes[:, m]][None]) ** 2).sum(2) for m in range(4)).round(9)
    found = knn.pq_search(q, base, books, 10)
    assert rows(found) == best(-far, 10)


def test_product_codes_make_no_pairs(spark, vectors):
    _, base, q = vectors
    assert paired(knn.pq_search(q, base, knn.pq_codebooks(base.filter("v is not null"), 4, 8, 6), 10)) == 0


def shared_buckets(queries, base, **index):
    """Pairs of queries and items, as knn.multiprobe_candidates lists them."""
    pairs = {(r.query_id, r.item_id) for r in knn.multiprobe_candidates(queries, base.filter("v is not null"), 8, **index).collect()}
    return np.array([[(11 * i, j) in pairs for j in range(300)] for i in range(28)])


INDEXES = [{"tables": 2, "n_probes": 3}, {"tables": 3, "total_probes": 7}, {"tables": 2, "n_probes": 2, "base_probes": 2, "bucket_cap": 9, "alpha": 0.1}]


@pytest.mark.parametrize("index", INDEXES)
def test_buckets(spark, vectors, way, index):
    x, base, q = vectors
    in_bucket = shared_buckets(q, base, **index)
    assert 0.05 < in_bucket.mean() < 0.95
    far = ((x[::11, None] - x[None]) ** 2).sum(2)
    assert rows(knn.multiprobe(q, base, 10, 8, **index)) == best(-far, 10, in_bucket)
    by_product = {(a, i) for a, _, i in best((x[::11, None] * x[None]).sum(2), 15, in_bucket)}
    again = np.array([[(11 * i, j) in by_product for j in range(300)] for i in range(28)])
    assert rows(knn.multiprobe(q, base, 10, 8, rerank=15, **index)) == best(-far, 10, again)


def test_buckets_make_no_pairs(spark, vectors):
    _, base, q = vectors
    assert paired(knn.multiprobe(q, base, 10, 8, rerank=15, **INDEXES[0])) == 0 == paired(knn.multiprobe(q, base, 10, 8, **INDEXES[1]))


def test_copies_of_an_id_share_its_buckets(spark, way):
    base = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.1]), (0, [0.0, 0.9, 0.3, 0.0]), (1, [1.0, 0.1, 0.0, 0.0]), (2, [0.0, 1.0, 0.2, 0.0])], "item_id long, v array<double>")
    q = base.filter("item_id = 0").limit(2).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    pairs = {r.item_id for r in knn.multiprobe_candidates(q, base, 4, tables=1, n_probes=1).collect()}
    found = knn.multiprobe(q, base, 20, 4, tables=1, n_probes=1)
    assert {r.item_id for r in found.collect()} == pairs and found.count() == 2 * (len(pairs) + 1)


def test_trained_codes(spark, vectors, way):
    from driftkeep.operators import pq

    x, base, q = vectors
    books = pq.fit_codebooks(base, parts=2, codes=16)
    decoded = pq.decode(pq.encode(x, books), books)
    in_bucket = shared_buckets(q, base, tables=2, n_probes=6)
    near = {(a, i) for a, _, i in best(-((x[::11, None] - decoded[None]) ** 2).sum(2), 40, in_bucket)}
    again = np.array([[(11 * i, j) in near for j in range(300)] for i in range(28)])
    found = pq.search(q, base, books, 10, 8, rerank=40, tables=2, n_probes=6)
    assert rows(found) == best(-((x[::11, None] - x[None]) ** 2).sum(2), 10, again)
    assert paired(pq.search(q, base, books, 10, 8, tables=2, n_probes=6)) == 0 or scans.QUERY_ROWS == 7


def test_unique_ids_count_by_their_best_copy(spark, vectors, way):
    x, base, q = vectors
    many = base.unionByName(base.withColumn("v", F.transform("v", lambda a: a * 0.5))).unionByName(base)
    s = (x[::11, None] * x[None]).sum(2)
    found = knn.exact_unique(q, many, 10)
    assert rows(found) == best(np.maximum(s, s / 2), 10)
    assert paired(found) == 0 or scans.QUERY_ROWS == 7


def test_hamming(spark, vectors, way):
    from driftkeep.functions import hashing

    x, base, q = vectors
    signs = x @ hashing.hyperplanes(1, 32, 8, 7).T > 0
    found = knn.hamming(q, base, 10, 32, 8)
    assert rows(found) == best(-(signs[::11, None] != signs[None]).sum(2), 10)
    assert {r.score for r in found.filter("rank = 1").collect()} == {0.0}
    assert paired(found) == 0 or scans.QUERY_ROWS == 7


def test_regions(spark, vectors, way):
    x, base, q = vectors
    centroids = spark.createDataFrame([(i, np.eye(8)[i].tolist()) for i in range(6)], "region long, c array<double>")
    near = np.argsort(-x[::11, :6], axis=1)[:, :2]
    allowed = (np.arange(300) % 6)[None, :, None] == near[:, None, :]
    found = knn.routed(q, base, centroids, 10, 2)
    assert rows(found) == best((x[::11, None] * x[None]).sum(2), 10, allowed.any(2))
    assert paired(found) == 0 or scans.QUERY_ROWS == 7


def test_settings_of_bucket_tables(spark, vectors, way):
    x, base, q = vectors
    settings = [(1, 1), (1, 3), (2, 1), (2, 3)]
    found = knn.bucket_sweep(q, base, 5, 8, settings).collect()
    for i, (t, p) in enumerate(settings):
        met = shared_buckets(q, base, tables=t, n_probes=p)
        assert {(r.query_id, r["rank"], r.item_id) for r in found if r.cell == i and r.n == 0} == best((x[::11, None] * x[None]).sum(2), 5, met)
        assert sum(r.n for r in found if r.cell == i) == met.sum()
    assert paired(knn.bucket_sweep(q, base, 5, 8, settings)) == 0 or scans.QUERY_ROWS == 7


def test_sets_in_one_pass(spark, vectors, way):
    x, base, q = vectors
    found = knn.exact_by_cell(q, base, 10, [F.col("item_id") < 4, F.col("region") == 2, F.lit(True)])
    for i, held in enumerate((np.arange(300) < 4, np.arange(300) % 6 == 2, np.ones(300, bool))):
        assert rows(found.filter(F.col("cell") == i)) == best((x[::11, None] * x[None]).sum(2), 10, np.repeat(held[None], 28, 0))


@pytest.mark.parametrize("at_least", [0.1, 0.3, 0.6])
def test_signature_pairs(spark, at_least):
    sig = np.random.default_rng(1).integers(0, 3, (200, 4))
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sig)], "pos long, sig array<long>")
    reps, n = {}, {}
    for i, s in enumerate(map(tuple, sig.tolist())):
        reps.setdefault(s, i)
        n[reps[s]] = n.get(reps[s], 0) + 1
    m = lambda s, t: sum(a == b for a, b in zip(s, t, strict=True))
    want = {(a, b, n[a], n[b], m(s, t) / (8 - m(s, t))) for s, a in reps.items() for t, b in reps.items() if a < b and m(s, t) and m(s, t) / (8 - m(s, t)) >= at_least}
    found = knn.signature_pairs(df, 4, at_least)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_signature_pairs_meet_once(spark):
    """Pairs of the few keys of single tables were rows, to be counted; now classes meet by two tables and a pair is made once."""
    sig = np.random.default_rng(1).integers(0, 3, (200, 4))
    found = knn.signature_pairs(spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sig)], "pos long, sig array<long>"), 4, 0.3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
