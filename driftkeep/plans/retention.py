"""Queries over streams, retention policies and what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.functions.vectors import rounded
from driftkeep.operators import knn, metrics, policies, reports, streams
from driftkeep.plans.fragments import BASE, BITS, DIM, POS, QUERIES, SIG, TABLES, h, machine, top, with_
from driftkeep.plans.search import DUP_SQL, K, ask, base, signed, stream

B = 10


def _half(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    s = stream(spark, d)
    n = s.count()
    return s, n, n // 2


def _ids(df: DataFrame) -> DataFrame:
    return df.select("pos", "item_id")


def fifo(spark: SparkSession, d: str) -> DataFrame:
    s, _, half = _half(spark, d)
    return _ids(policies.fifo(s, half))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    s, _, half = _half(spark, d)
    return _ids(policies.freshness(s, half))


def reservoir(spark: SparkSession, d: str) -> DataFrame:
    s, _, half = _half(spark, d)
    return _ids(policies.reservoir(s, half))


def bernoulli(spark: SparkSession, d: str) -> DataFrame:
    s, n, half = _half(spark, d)
    return _ids(policies.bernoulli(s, half, n))


def keep_all(spark: SparkSession, d: str) -> DataFrame:
    return _ids(policies.keep_all(stream(spark, d)))


_HALF = "(SELECT count(*) // 2 FROM s)"
FIFO_K = f"k AS (SELECT pos, item_id, v, label FROM s QUALIFY row_number() OVER (ORDER BY pos DESC) <= {_HALF})"
FIFO_SQL = with_(BASE, POS, FIFO_K, select="SELECT pos, item_id FROM k")
RESERVOIR_SQL = with_(BASE, POS, select=f"SELECT pos, item_id FROM s QUALIFY row_number() OVER (ORDER BY {h('pos', 42)}, pos) <= {_HALF}")
BERNOULLI_SQL = with_(BASE, POS, select=f"SELECT pos, item_id FROM s WHERE {h('pos', 42)} / 4294967296.0::DOUBLE < {_HALF} / (SELECT count(*) FROM s)::DOUBLE")
ALL_SQL = with_(BASE, POS, select="SELECT pos, item_id FROM s")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    s, _, half = _half(spark, d)
    return policies.fifo(s, half)


def _recall(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    q = ask(spark, d)
    return metrics.recall(knn.exact(q, base(spark, d), k), knn.exact(q, _kept(spark, d).select("item_id", "v"), k), k)


_TRUTH = f"t AS ({top('list_inner_product(q.q, e.v)', K, 'q, e')})"
_FOUND = f"f AS ({top('list_inner_product(q.q, k.v)', K, 'q, k')})"


def _rc(k: int = K) -> str:
    return f"SELECT q.query_id, count(f.item_id) / {k}.0::DOUBLE AS recall FROM q LEFT JOIN t ON t.query_id = q.query_id AND t.rank <= {k} LEFT JOIN f ON f.query_id = t.query_id AND f.item_id = t.item_id AND f.rank <= {k} GROUP BY q.query_id"


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d).select("query_id", rounded(F.col("recall")).alias("recall"))


RECALL_SQL = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, _FOUND, select=f"SELECT query_id, round(recall, 6) AS recall FROM ({_rc()})")


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def recall_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.distribution(_recall(spark, d)))


def _dist(x: str) -> str:
    return f"round(avg({x}), 6) AS mean, round(stddev_pop({x}), 6) AS std, round(quantile_cont({x}, 0.1), 6) AS p10, round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.9), 6) AS p90, round(avg(({x} = 0)::INTEGER), 6) AS zero_frac"


DIST_SQL = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, _FOUND, f"rc AS ({_rc()})", select=f"SELECT {_dist('recall')} FROM rc")


def recall_multi_k(spark: SparkSession, d: str) -> DataFrame:
    q, ks = ask(spark, d), (1, 5, 10)
    truth, found = knn.exact(q, base(spark, d), 10), knn.exact(q, _kept(spark, d).select("item_id", "v"), 10)
    parts = [metrics.recall(truth, found, k).agg(F.avg("recall").alias("r")).select(F.lit(k).cast("long").alias("k"), rounded(F.col("r")).alias("recall")) for k in ks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MULTI_K_SQL = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, _FOUND, select=" UNION ALL ".join(f"SELECT {k}::BIGINT AS k, round(avg(recall), 6) AS recall FROM ({_rc(k)})" for k in (1, 5, 10)))


def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.coverage(knn.exact(ask(spark, d), base(spark, d), K), _kept(spark, d), K))


COVER_SQL = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, select="SELECT round(count(k.item_id) / count(*)::DOUBLE, 6) AS coverage FROM (SELECT DISTINCT item_id FROM t) x LEFT JOIN k USING (item_id)")


def cluster_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.cluster_coverage(_kept(spark, d), 10))


ENTROPY_SQL = with_(BASE, POS, FIFO_K, "c AS (SELECT label, count(*) AS n FROM k GROUP BY label)", "p AS (SELECT n / (sum(n) OVER ())::DOUBLE AS p FROM c)", select="SELECT count(*) AS n_covered, round(count(*) / 10.0::DOUBLE, 6) AS fraction, round(sum(-p * ln(p)), 6) + 0.0 AS entropy FROM p")


_SAMPLE = f"sm AS (SELECT * FROM e ORDER BY {h('item_id', 42)}, item_id LIMIT {metrics.STREAM_SAMPLE})"
_KSAMPLE = f"ks AS (SELECT * FROM k ORDER BY {h('item_id', 42)}, item_id LIMIT {metrics.KEPT_SAMPLE})"
_SQD = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_OTHER = "a.item_id <> b.item_id"


def _near(f: str, x: str, probe: str, among: str, on: str = "true") -> str:
    return f"nn AS (SELECT a.item_id, {f}({x}) AS best FROM {probe} a JOIN {among} b ON {on} GROUP BY a.item_id)"


def k_center(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.k_center_radius(base(spark, d), _kept(spark, d)))


def cosine_radius(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.cosine_radius(base(spark, d), _kept(spark, d)))


KCENTER_SQL = with_(BASE, POS, FIFO_K, _SAMPLE, _near("min", _SQD, "sm", "k"), select="SELECT round(sqrt(max(best)), 6) AS radius FROM nn")
CRADIUS_SQL = with_(BASE, POS, FIFO_K, _SAMPLE, _near("max", "list_inner_product(a.v, b.v)", "sm", "k"), select="SELECT round(1 - min(best), 6) AS cosine_radius FROM nn")


def intra_distance(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.intra_distance(_kept(spark, d)))


def cosine_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.cosine_stats(_kept(spark, d)))


def cosine_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cosine_stats(base(spark, d), metrics.STREAM_SAMPLE).select(rounded(F.col("mean_nn_cosine")).alias("redundancy"))


INTRA_SQL = with_(BASE, POS, FIFO_K, _KSAMPLE, _near("min", _SQD, "ks", "ks", _OTHER), select="SELECT round(avg(sqrt(best)), 6) AS mean_nn_distance FROM nn")
_COS = "list_inner_product(a.v, b.v)"
CSTATS_SQL = with_(BASE, POS, FIFO_K, _KSAMPLE, _near("max", _COS, "ks", "ks", _OTHER), select="SELECT round(avg(best), 6) AS mean_nn_cosine, round(max(best), 6) AS max_nn_cosine, round(quantile_cont(best, 0.9), 6) AS p90_nn_cosine, round(1 - avg(best), 6) AS diversity FROM nn")
CREDUND_SQL = with_(BASE, _SAMPLE, _near("max", _COS, "sm", "sm", _OTHER), select="SELECT round(avg(best), 6) AS redundancy FROM nn")


def stream_redundancy(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.stream_redundancy(base(spark, d)))


REDUND_SQL = with_(
    BASE, _SAMPLE, _near("min", _SQD, "sm", "sm", _OTHER),
    f"li AS (SELECT v, row_number() OVER (ORDER BY {h('item_id', 42)}, item_id) - 1 AS i FROM sm)",
    f"pr AS (SELECT {h('j', 43)} % (SELECT count(*) FROM sm) AS x, {h('j', 44)} % (SELECT count(*) FROM sm) AS y FROM (SELECT unnest(range(0, {metrics.PAIRS})) AS j))",
    f"far AS (SELECT max(sqrt({_SQD})) AS far FROM pr JOIN li a ON a.i = x JOIN li b ON b.i = y)",
    select="SELECT round(1 - (SELECT avg(sqrt(best)) FROM nn) / far, 6) AS redundancy FROM far",
)


def memory(spark: SparkSession, d: str) -> DataFrame:
    n = _kept(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return _round_all(n.select("n", *metrics.memory_footprint(F.col("n"), DIM, 8, 10)))


MEMORY_SQL = with_(BASE, POS, FIFO_K, "c AS (SELECT count(*) AS n, count(*) * 256.0::DOUBLE AS a, count(*) * 10.0::DOUBLE AS b, 32768.0::DOUBLE AS c FROM k)", select="SELECT n, round(a / 1e6, 6) AS vectors_mb, round(b / 1e6, 6) AS signatures_mb, round(c / 1e6, 6) AS counters_mb, round((a + b + c) / 1e6, 6) AS total_mb, round((b + c) / (a + b + c), 6) AS overhead FROM c")


def distance_ratio(spark: SparkSession, d: str) -> DataFrame:
    q = ask(spark, d)
    return _round_all(metrics.distance_ratio(knn.exact(q, base(spark, d), 1), knn.exact(q, _kept(spark, d).select("item_id", "v"), 1)))


RATIO_SQL = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, _FOUND, select="SELECT round(avg(CASE WHEN 1 - t.score >= 1e-6 THEN (1 - f.score) / (1 - t.score) WHEN 1 - f.score < 1e-6 THEN 1.0 ELSE 10.0 END), 6) AS distance_ratio FROM t JOIN f USING (query_id) WHERE t.rank = 1 AND f.rank = 1")


def evaluation_row(spark: SparkSession, d: str) -> DataFrame:
    """One flat row of every metric of a kept set."""
    kept, q = _kept(spark, d), ask(spark, d)
    truth, found = knn.exact(q, base(spark, d), K), knn.exact(q, kept.select("item_id", "v"), K)
    n = kept.agg(F.count(F.lit(1)).alias("n")).select("n", *metrics.memory_footprint(F.col("n"), DIM, 8, 10))
    multi = [metrics.recall(truth, found, k).agg(F.avg("recall").alias(f"recall_at_{k}")) for k in (1, 5, 10)]
    parts = [metrics.distribution(metrics.recall(truth, found, K)), *multi, metrics.coverage(truth, kept, K), metrics.cluster_coverage(kept, 10), metrics.k_center_radius(base(spark, d), kept), metrics.cosine_radius(base(spark, d), kept), metrics.intra_distance(kept), metrics.cosine_stats(kept), n]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return _round_all(out)


_MULTI_ROW = with_(BASE, QUERIES, POS, FIFO_K, _TRUTH, _FOUND, select="SELECT " + ", ".join(f"(SELECT round(avg(recall), 6) FROM ({_rc(k)})) AS recall_at_{k}" for k in (1, 5, 10)))
EVAL_SQL = "SELECT * FROM " + ", ".join(f"({x})" for x in (DIST_SQL, _MULTI_ROW, COVER_SQL, ENTROPY_SQL, KCENTER_SQL, CRADIUS_SQL, INTRA_SQL, CSTATS_SQL, MEMORY_SQL))


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return signed(spark, d).select(F.posexplode("sig").alias("t", "bucket")).groupBy(F.col("t").cast("long").alias("t"), "bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.histogram(signed(spark, d))


COUNTS_SQL = with_(BASE, POS, SIG, select="SELECT t::BIGINT AS t, bucket, count(*) AS n FROM buckets GROUP BY ALL")
HIST_SQL = with_(BASE, POS, SIG, select="SELECT occupancy, count(*) AS buckets FROM (SELECT t, bucket, count(*) AS occupancy FROM buckets GROUP BY ALL) GROUP BY ALL")


def fill(aggregator: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return policies.fill_occupancy(signed(spark, d), TABLES).select("pos", rounded(F.col(f"occ_{aggregator}")).alias("occ"))

    f = {"mean": "avg"}.get(aggregator, aggregator)
    return run, with_(BASE, POS, SIG, "o AS (SELECT pos, (count(*) OVER (PARTITION BY t, bucket ORDER BY pos) - 1)::DOUBLE AS n FROM buckets)", select=f"SELECT pos, round({f}(n), 6) AS occ FROM o GROUP BY pos")


def dup_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.with_duplicates(base(spark, d), 0.5).select("pos", "item_id", "is_dup")


DUPS_SQL = with_(BASE, POS, DUP_SQL, select="SELECT pos, item_id, is_dup FROM dup")


def clean_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.clean(base(spark, d)).select("pos", "item_id")


def drift_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.drift(base(spark, d)).select("pos", "item_id", "label")


def drift_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return streams.boundaries(streams.drift(base(spark, d)))


CLEAN_SQL = with_(BASE, select=f"SELECT row_number() OVER (ORDER BY {h('item_id', 43)}, item_id) - 1 AS pos, item_id FROM e")
DRIFT_SQL = with_(BASE, select="SELECT row_number() OVER (ORDER BY label, item_id) - 1 AS pos, item_id, label FROM e")
BOUND_SQL = with_(BASE, select="SELECT label, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT label, row_number() OVER (ORDER BY label, item_id) - 1 AS pos FROM e) GROUP BY label")


N_SAMPLE = 5_000


def query_sample(spark: SparkSession, d: str) -> DataFrame:
    return streams.query_sample(base(spark, d), N_SAMPLE).select("query_id")


SAMPLE_SQL = with_(BASE, select=f"SELECT item_id AS query_id FROM e ORDER BY {h('item_id', 42)}, item_id LIMIT {N_SAMPLE}")


def footprint_grid(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d).count()
    return spark.createDataFrame(streams.equal_footprint(n, [0.01, 0.1, 0.5], [64, 32, 16], DIM), "fraction double, dim long, capacity long")


GRID_SQL = with_(BASE, select=f"SELECT fraction, dim::BIGINT AS dim, (greatest(floor(n * fraction), 5) * {DIM} / dim)::BIGINT AS capacity FROM (SELECT count(*) AS n FROM e), (SELECT unnest([0.01::DOUBLE, 0.1, 0.5]) AS fraction), (SELECT unnest([64, 32, 16]) AS dim)")


def _log(spark: SparkSession, d: str, aggregator: str, threshold: float | None = None) -> DataFrame:
    keyed = signed(spark, d).withColumnRenamed("label", "key")
    return policies.bucket_occupancy(keyed, B, aggregator, threshold)


def occupancy(aggregator: str, threshold: float | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _log(spark, d, aggregator, threshold).select("key", "pos", "item_id", "accepted", rounded(F.col("occ")).alias("occ"), "evicted")

    return run, with_(BASE, POS, SIG, machine(B, aggregator, threshold), select="SELECT label AS key, pos, item_id, accepted, round(occ, 6) AS occ, evicted FROM log")


_KEPT_LOG = "gone AS (SELECT label, evicted AS pos FROM log WHERE evicted IS NOT NULL), kp AS (SELECT log.label, log.pos, log.item_id FROM log WHERE accepted AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.label = log.label AND gone.pos = log.pos))"


def occupancy_kept(spark: SparkSession, d: str) -> DataFrame:
    return policies.kept(_log(spark, d, "median"))


KEPT_SQL = with_(BASE, POS, SIG, machine(B, "median"), _KEPT_LOG, select="SELECT label AS key, pos, item_id FROM kp")


def policy_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(policies.stats(_log(spark, d, "median"), signed(spark, d).withColumnRenamed("label", "key")))


STATS_SQL = with_(
    BASE, POS, SIG, machine(B, "median"), _KEPT_LOG,
    "bo AS (SELECT label, count(*) AS active_buckets, avg(n) AS mean_occupancy, max(n) AS max_occupancy FROM (SELECT b.label, t, bucket, count(*) AS n FROM buckets b JOIN kp ON kp.pos = b.pos GROUP BY ALL) GROUP BY label)",
    select="SELECT log.label AS key, count(*) AS seen, any_value(k.n) AS kept, count(*) - sum(accepted::INT)::BIGINT AS discarded, round(sum(accepted::INT) / count(*)::DOUBLE, 6) AS retention_rate, any_value(active_buckets) AS active_buckets, round(any_value(mean_occupancy), 6) AS mean_occupancy, any_value(max_occupancy) AS max_occupancy FROM log JOIN bo USING (label) JOIN (SELECT label, count(*) AS n FROM kp GROUP BY label) k USING (label) GROUP BY log.label",
)
EPS = 0.75


def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    log = policies.semantic_dedup(stream(spark, d).withColumnRenamed("label", "key"), 40, EPS)
    return policies.kept(log)


SEMANTIC_SQL = with_(
    BASE, POS, "o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS i FROM s)",
    f"cf AS (SELECT b.label, b.i, b.pos, b.item_id, coalesce(list(a.pos) FILTER (WHERE list_inner_product(a.v, b.v) > {1 - EPS}), []::BIGINT[]) AS bad FROM o b LEFT JOIN o a ON a.label = b.label AND a.i < b.i GROUP BY b.label, b.i, b.pos, b.item_id)",
    """r(label, i, kept) AS (SELECT DISTINCT label, 0::BIGINT, []::BIGINT[] FROM cf UNION ALL
  SELECT cf.label, cf.i, CASE WHEN len(kept) < 40 AND len(list_intersect(kept, bad)) = 0 THEN list_append(kept, cf.pos) ELSE kept END FROM r JOIN cf ON cf.label = r.label AND cf.i = r.i + 1)""",
    "last AS (SELECT label, kept FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY i DESC) = 1)",
    select="SELECT label AS key, pos, s.item_id FROM (SELECT label, unnest(kept) AS pos FROM last) JOIN s USING (label, pos)",
)


def reservoir_r(spark: SparkSession, d: str) -> DataFrame:
    return policies.kept(policies.reservoir_r(stream(spark, d).withColumnRenamed("label", "key"), B))


def dup_discard(spark: SparkSession, d: str) -> DataFrame:
    dup = streams.with_duplicates(base(spark, d), 0.5)
    keep = policies.bernoulli(dup, 1, 3, 9).select("pos", F.lit(True).alias("accepted"))
    log = dup.join(keep, "pos", "left").select("is_dup", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    return _round_all(reports.duplicate_discard(log))


DISCARD_SQL = with_(BASE, POS, DUP_SQL, f"a AS (SELECT is_dup, {h('pos', 9)} / 4294967296.0::DOUBLE < 1 / 3.0::DOUBLE AS ok FROM dup)", "c AS (SELECT count(*) FILTER (WHERE is_dup) AS dup_total, count(*) FILTER (WHERE NOT is_dup) AS orig_total, count(*) FILTER (WHERE is_dup AND ok) AS dup_accepted, count(*) FILTER (WHERE NOT is_dup AND ok) AS orig_accepted FROM a)", select="SELECT *, round(1 - dup_accepted / dup_total::DOUBLE, 6) AS dup_discard_rate, round(orig_accepted / orig_total::DOUBLE, 6) AS orig_keep_rate FROM c")


def sliding(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d, "median").withColumnRenamed("key", "label")
    return _round_all(reports.sliding(log, 100, base(spark, d).count()))


SLIDING_SQL = with_(BASE, POS, SIG, machine(B, "median"), "w AS (SELECT st AS start, log.* FROM log, (SELECT unnest(range(0, (SELECT count(*) FROM s), 50)) AS st) WHERE pos >= st AND pos < st + 100)", "c AS (SELECT start, label, count(*) AS n FROM w GROUP BY ALL)", "m AS (SELECT start, label AS modal_label FROM c QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC, label) = 1)", select="SELECT start, round(avg(accepted::INT), 6) AS acceptance, sum(accepted::INT)::BIGINT AS accepted, any_value(modal_label) AS modal_label, count(DISTINCT label) AS labels FROM w JOIN m USING (start) GROUP BY start")


def steady_state(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(reports.running_size(_log(spark, d, "median"), 50, base(spark, d).count()))


STEADY_SQL = with_(BASE, POS, SIG, machine(B, "median"), "z AS (SELECT label AS key, pos, sum(accepted::INT - (evicted IS NOT NULL)::INT) OVER (PARTITION BY label ORDER BY pos)::BIGINT AS kept FROM log)", select="SELECT key, pos, kept, round(kept / (pos + 1)::DOUBLE, 6) AS share FROM z WHERE pos % 50 = 0 OR pos = (SELECT count(*) - 1 FROM s)")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Histograms after a tenth, half and all of the stream."""
    n = base(spark, d).count()
    return reports.snapshots(signed(spark, d), [n // 10, n // 2, n])


SNAP_SQL = with_(BASE, POS, SIG, select="SELECT checkpoint, occupancy, count(*) AS buckets FROM (SELECT cp::BIGINT AS checkpoint, t, bucket, count(*) AS occupancy FROM buckets, (SELECT unnest([count(*) // 10, count(*) // 2, count(*)]) AS cp FROM s) WHERE pos < cp GROUP BY ALL) GROUP BY ALL")


ENTRIES = {
    "fifo_kept": (fifo, FIFO_SQL), "streamlsh_kept": (freshness, FIFO_SQL), "reservoir_hash_kept": (reservoir, RESERVOIR_SQL), "bernoulli_kept": (bernoulli, BERNOULLI_SQL), "oracle_kept": (keep_all, ALL_SQL), "reservoir_r_kept": (reservoir_r, None),
    "recall_at_k": (recall_at_k, RECALL_SQL), "recall_distribution": (recall_distribution, DIST_SQL), "recall_multi_k": (recall_multi_k, MULTI_K_SQL), "query_coverage": (query_coverage, COVER_SQL), "cluster_coverage_entropy": (cluster_entropy, ENTROPY_SQL),
    "k_center_radius": (k_center, KCENTER_SQL), "cosine_coverage_radius": (cosine_radius, CRADIUS_SQL), "intra_set_distance": (intra_distance, INTRA_SQL), "nn_cosine_stats": (cosine_stats, CSTATS_SQL), "cosine_redundancy": (cosine_redundancy, CREDUND_SQL), "stream_redundancy": (stream_redundancy, REDUND_SQL),
    "memory_footprint": (memory, MEMORY_SQL), "distance_error_ratio": (distance_ratio, RATIO_SQL), "evaluation_row": (evaluation_row, EVAL_SQL), "bucket_counts": (bucket_counts, COUNTS_SQL), "bucket_histogram": (bucket_histogram, HIST_SQL),
    **{f"fill_occupancy_{a}": fill(a) for a in ("min", "max", "mean", "median")},
    "dup_stream": (dup_stream, DUPS_SQL), "clean_stream": (clean_stream, CLEAN_SQL), "drift_stream": (drift_stream, DRIFT_SQL), "drift_boundaries": (drift_boundaries, BOUND_SQL), "query_sample": (query_sample, SAMPLE_SQL), "equal_footprint_grid": (footprint_grid, GRID_SQL),
    "bucket_occupancy_capacity": occupancy("median"), "bucket_occupancy_min": occupancy("min"), "bucket_occupancy_max": occupancy("max"), "bucket_occupancy_mean": occupancy("mean"), "bucket_occupancy_threshold": occupancy("median", 3.0), "bucket_occupancy_jaccard": occupancy("jaccard"), "bucket_occupancy_jaccard_threshold": occupancy("jaccard", 0.5),
    "bucket_occupancy_kept": (occupancy_kept, KEPT_SQL), "policy_stats": (policy_stats, STATS_SQL), "semantic_dedup": (semantic_dedup, SEMANTIC_SQL), "dup_discard_rates": (dup_discard, DISCARD_SQL), "sliding_retention": (sliding, SLIDING_SQL), "steady_state_size": (steady_state, STEADY_SQL), "occupancy_snapshots": (snapshots, SNAP_SQL),
}
