"""Grids over policies, budgets, signatures, projections and indexes, a flat row for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.functions import hashing
from driftkeep.functions.hashing import hash01, hash32
from driftkeep.functions.vectors import rounded
from driftkeep.operators import knn, pq, policies, reports, streams
from driftkeep.plans.fragments import BASE, BITS, DIM, POS, QUERIES, SIG, TABLES, h, machine, numbers, sig_sql, top, with_
from driftkeep.plans.search import K, LP, LT, _filed, ask, base, dup_sql, show, signed, stream

FRACTIONS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0)
KINDS = ("Bernoulli", "FIFO", "Reservoir")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def policy_budget(spark: SparkSession, d: str) -> DataFrame:
    """Recall, coverage and labels of what each policy keeps under each budget, all cells in one pass over the stream."""
    s = stream(spark, d).withColumnRenamed("pos", "at").withColumn("h", hash32("at", 42))
    n = s.count()
    ranked = streams.positions(s, F.col("h"), F.col("at"))
    cells = [(i, p, f, max(int(n * f), 5)) for i, (p, f) in enumerate((p, f) for p in KINDS for f in FRACTIONS)]
    keeps = {"FIFO": lambda b: F.col("at") >= n - b, "Reservoir": lambda b: F.col("pos") < b, "Bernoulli": lambda b: hash01("at", 42) < F.lit(b / n)}
    kept = ranked.withColumn("cell", F.explode(F.array(*[F.when(keeps[p](b), F.lit(i)) for i, p, _, b in cells]))).filter("cell is not null")
    q = ask(spark, d)
    truth = knn.exact(q, base(spark, d), K).select("query_id", "item_id")
    found = knn.exact_by_cell(q, ranked, K, [keeps[p](b) for _, p, _, b in cells])
    hits = found.join(truth, ["query_id", "item_id"]).groupBy("cell").agg(F.count(F.lit(1)).alias("hits"))
    asked = truth.agg(F.countDistinct("query_id").alias("asked"), F.countDistinct("item_id").alias("true_items"))
    covered = kept.select("cell", "item_id").distinct().join(truth.select("item_id").distinct(), "item_id").groupBy("cell").agg(F.count(F.lit(1)).alias("covered"))
    sizes = kept.groupBy("cell").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("label").alias("labels"))
    out = spark.createDataFrame(cells, "cell int, policy string, fraction double, capacity long")
    for part in (sizes, hits, covered):
        out = out.join(part, "cell", "left")
    out = out.fillna(0).join(F.broadcast(asked))  # one row
    return _round(out.select("policy", "fraction", "capacity", "kept", "labels", (F.col("hits") / (F.col("asked") * float(K))).alias("recall"), (F.col("covered") / F.col("true_items")).alias("coverage")))


_TRUTH = f"t AS ({top('list_inner_product(q.q, e.v)', K, 'q, e')})"
POLICY_SQL = with_(
    BASE, QUERIES, POS, _TRUTH,
    f"r AS (SELECT *, row_number() OVER (ORDER BY {h('pos', 42)}, pos) AS rr, {h('pos', 42)} / 4294967296.0::DOUBLE AS u, count(*) OVER () AS n FROM s)",
    f"ce AS (SELECT policy, fraction, greatest(floor(n * fraction), 5)::BIGINT AS capacity FROM (SELECT count(*) AS n FROM e), (SELECT unnest({list(KINDS)}) AS policy), (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.25, 0.5, 1.0]) AS fraction))",
    "k AS (SELECT policy, fraction, item_id, v, label FROM ce, r WHERE CASE policy WHEN 'FIFO' THEN pos >= n - capacity WHEN 'Reservoir' THEN rr <= capacity ELSE u < capacity / n::DOUBLE END)",
    f"f AS (SELECT policy, fraction, query_id, item_id FROM k, q QUALIFY row_number() OVER (PARTITION BY policy, fraction, query_id ORDER BY list_inner_product(q.q, k.v) DESC, item_id) <= {K})",
    "hi AS (SELECT policy, fraction, count(*) AS hits FROM f JOIN t USING (query_id, item_id) GROUP BY ALL)",
    "co AS (SELECT policy, fraction, count(DISTINCT item_id) AS covered FROM k WHERE item_id IN (SELECT item_id FROM t) GROUP BY ALL)",
    "sz AS (SELECT policy, fraction, count(*) AS kept, count(DISTINCT label) AS labels FROM k GROUP BY ALL)",
    select=f"SELECT policy, fraction, capacity, coalesce(kept, 0) AS kept, coalesce(labels, 0) AS labels, round(coalesce(hits, 0) / ((SELECT count(*) FROM q) * {K}.0::DOUBLE), 6) AS recall, round(coalesce(covered, 0) / (SELECT count(DISTINCT item_id) FROM t)::DOUBLE, 6) AS coverage FROM ce LEFT JOIN sz USING (policy, fraction) LEFT JOIN hi USING (policy, fraction) LEFT JOIN co USING (policy, fraction)",
)
CELLS = [(a, b, None) for a in ("max", "median", "jaccard") for b in (5, 10, 20)]


def occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Accepted, evicted and kept of bucket occupancy by aggregator and capacity."""
    log = policies.occupancy_grid(signed(spark, d).withColumnRenamed("label", "key"), CELLS)
    named = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CELLS)], "cell int, aggregator string, capacity long")
    n = log.groupBy("cell").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.count("evicted").alias("evicted"))
    return named.join(n, "cell").select("aggregator", "capacity", "seen", "accepted", "evicted", (F.col("accepted") - F.col("evicted")).alias("kept"))


OCCUPANCY_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS aggregator, {b}::BIGINT AS capacity, seen, accepted, evicted, accepted - evicted AS kept FROM ({with_(BASE, POS, SIG, machine(b, a), select='SELECT count(*) AS seen, sum(accepted::INT)::BIGINT AS accepted, count(evicted) AS evicted FROM log')})"
    for a, b, _ in CELLS
)
SWEPT_BITS = (2, 4, 6)


def signature_bits(spark: SparkSession, d: str) -> DataFrame:
    """Buckets in use, mean and largest occupancy by bits of the signature."""
    out = None
    for bits in SWEPT_BITS:
        n = stream(spark, d).select(F.posexplode(hashing.simhash(F.col("v"), TABLES, bits, DIM)).alias("t", "b")).groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"))
        row = n.agg(F.lit(bits).cast("long").alias("bits"), F.count(F.lit(1)).alias("buckets"), rounded(F.avg("n")).alias("mean_occupancy"), F.max("n").alias("max_occupancy"))
        out = row if out is None else out.unionByName(row)
    return out


BITS_SQL = " UNION ALL ".join(
    f"SELECT {b}::BIGINT AS bits, buckets, mean_occupancy, max_occupancy FROM ({with_(BASE, POS, sig_sql(TABLES, b), 'c AS (SELECT t, bucket, count(*) AS n FROM buckets GROUP BY ALL)', select='SELECT count(*) AS buckets, round(avg(n), 6) AS mean_occupancy, max(n) AS max_occupancy FROM c')})"
    for b in SWEPT_BITS
)
DIMS = (32, 16, 8)


def projections(spark: SparkSession, d: str) -> DataFrame:
    """Recall of exact search after projection, by dimension."""
    truth = knn.exact(ask(spark, d), base(spark, d), K).select("query_id", "item_id")
    asked = truth.agg(F.countDistinct("query_id").alias("asked"))
    out = None
    for to in DIMS:
        low = streams.jl_projected(base(spark, d), DIM, to)
        q = low.join(truth.select(F.col("query_id").alias("item_id")).distinct(), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
        hits = knn.exact(q, low, K).join(truth, ["query_id", "item_id"]).agg(F.count(F.lit(1)).alias("hits"))
        row = hits.join(F.broadcast(asked)).select(F.lit(to).cast("long").alias("dim"), rounded(F.col("hits") / (F.col("asked") * float(K))).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def _projected(to: int) -> str:
    m = numbers(streams.jl_matrix(DIM, to))
    return with_(
        BASE, QUERIES, _TRUTH,
        f"y AS (SELECT item_id, i, list_inner_product(v, w::DOUBLE[]) AS y FROM e, (SELECT unnest({m}) AS w, generate_subscripts({m}, 1) AS i))",
        "pv AS (SELECT item_id, list(y ORDER BY i) AS v FROM (SELECT item_id, i, y / sqrt(sum(y * y) OVER (PARTITION BY item_id)) AS y FROM y) GROUP BY item_id)",
        "pq AS (SELECT item_id AS query_id, v AS q FROM pv WHERE item_id IN (SELECT query_id FROM q))",
        f"f AS ({top('list_inner_product(pq.q, pv.v)', K, 'pq, pv')})",
        select=f"SELECT count(*) / ((SELECT count(*) FROM q) * {K}.0::DOUBLE) AS r FROM f JOIN t USING (query_id, item_id)",
    )


JL_SQL = " UNION ALL ".join(f"SELECT {to}::BIGINT AS dim, round(r, 6) AS recall FROM ({_projected(to)})" for to in DIMS)
SETTINGS = [(t, p) for t in range(1, LT + 1) for p in (1, LP)]


def ann(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and recall of multi-probe search by tables and probes; all settings in one pass over the base."""
    q, b = ask(spark, d), base(spark, d)
    truth = knn.exact(q, b, K).select("query_id", "item_id")
    near = knn.bucket_sweep(q, b, K, DIM, SETTINGS).join(truth.withColumn("true", F.lit(1)), ["query_id", "item_id"], "left")
    both = near.groupBy("cell").agg(F.sum("n").alias("candidates"), F.count("true").alias("hits"))
    n = q.agg(F.count(F.lit(1)).alias("asked"))
    named = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(SETTINGS)], "cell int, tables long, probes long")
    return named.join(both, "cell", "left").fillna(0).join(F.broadcast(n)).select("tables", "probes", "candidates", rounded(F.col("hits") / (F.col("asked") * float(K))).alias("recall"))


ANN_SQL = with_(
    BASE, QUERIES, _TRUTH, _filed("fe", "e", "item_id", "v", 1), _filed("fq", "q", "query_id", "q.q", LP),
    f"ce AS (SELECT tables, probes FROM (SELECT unnest(range(1, {LT + 1})) AS tables), (SELECT unnest([1, {LP}]) AS probes))",
    "c AS (SELECT DISTINCT tables, probes, query_id, item_id FROM ce JOIN fq ON tb < tables AND probe <= probes JOIN fe USING (tb, bucket))",
    "sc AS (SELECT c.*, list_inner_product(q.q, e.v) AS x FROM c JOIN q USING (query_id) JOIN e USING (item_id))",
    f"f AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY tables, probes, query_id ORDER BY x DESC, item_id) <= {K})",
    "hi AS (SELECT tables, probes, count(*) AS hits FROM f JOIN t USING (query_id, item_id) GROUP BY ALL)",
    "sz AS (SELECT tables, probes, count(*) AS candidates FROM c GROUP BY ALL)",
    select=f"SELECT tables::BIGINT AS tables, probes::BIGINT AS probes, coalesce(candidates, 0) AS candidates, round(coalesce(hits, 0) / ((SELECT count(*) FROM q) * {K}.0::DOUBLE), 6) AS recall FROM ce LEFT JOIN sz USING (tables, probes) LEFT JOIN hi USING (tables, probes)",
)
RATES = (0.1, 0.3, 0.5)


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Discard rate of copies and keep rate of originals of a thinned stream, by rate of duplicates."""
    out = None
    for rate in RATES:
        dup = streams.with_duplicates(base(spark, d), rate)
        row = reports.duplicate_discard(dup.withColumn("accepted", hash01("pos", 9) < F.lit(1 / 3))).withColumn("rate", F.lit(rate))
        out = row if out is None else out.unionByName(row)
    return _round(out)


def _duplicates(rate: float) -> str:
    ok = f"{h('pos', 9)} / 4294967296.0::DOUBLE < 1 / 3.0::DOUBLE"
    return with_(
        BASE, POS, dup_sql(rate), f"a AS (SELECT is_dup, {ok} AS ok FROM dup)",
        "c AS (SELECT count(*) FILTER (WHERE is_dup) AS dup_total, count(*) FILTER (WHERE NOT is_dup) AS orig_total, count(*) FILTER (WHERE is_dup AND ok) AS dup_accepted, count(*) FILTER (WHERE NOT is_dup AND ok) AS orig_accepted FROM a)",
        select="SELECT *, round(1 - dup_accepted / dup_total::DOUBLE, 6) AS dup_discard_rate, round(orig_accepted / orig_total::DOUBLE, 6) AS orig_keep_rate FROM c",
    )


DUPLICATES_SQL = " UNION ALL ".join(f"SELECT *, {r}::DOUBLE AS rate FROM ({_duplicates(r)})" for r in RATES)


def lsh_pq(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of multi-probe tables, the best 100 by trained codes, then exact scores."""
    b = base(spark, d)
    books = pq.fit_codebooks(b, parts=16, codes=64)
    return show(pq.search(ask(spark, d), b, books, K, DIM, tables=8, n_probes=32))


MEMORY_METHOD = "FIFO"


def recall_memory(spark: SparkSession, d: str) -> DataFrame:
    """Megabytes of vectors against recall of one policy's cells."""
    sized = policy_budget(spark, d).withColumn("vectors_mb", rounded(F.col("kept") * (DIM * 4.0) / 1e6))
    return reports.scatter(sized, "policy", MEMORY_METHOD, "vectors_mb", "recall")


RECALL_MEMORY_SQL = f"SELECT round(kept * {DIM * 4}.0::DOUBLE / 1e6, 6) AS vectors_mb, recall FROM ({POLICY_SQL}) WHERE policy = '{MEMORY_METHOD}'"
NAMES = {"FIFO": "most recent", "Reservoir": "uniform sample"}


def renamed(spark: SparkSession, d: str) -> DataFrame:
    return reports.renamed(policy_budget(spark, d), "policy", NAMES).select("policy", "fraction", "recall")


RENAMED_SQL = f"SELECT CASE policy WHEN 'FIFO' THEN 'most recent' ELSE 'uniform sample' END AS policy, fraction, recall FROM ({POLICY_SQL}) WHERE policy IN ('FIFO', 'Reservoir')"


def by_budget(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.by_budget(policy_budget(spark, d), "fraction", ["recall", "coverage", "mean_us"]))


BUDGET_SQL = f"SELECT fraction, round(avg(recall), 6) AS recall, round(avg(coverage), 6) AS coverage, 0.0::DOUBLE AS mean_us FROM ({POLICY_SQL}) GROUP BY fraction"


def occupancy_bins(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of bucket sizes over [0, p99 + 1]."""
    n = signed(spark, d).select(F.posexplode("sig").alias("t", "b")).groupBy("t", "b").agg(F.count(F.lit(1)).alias("size"))
    return _round(reports.histogram_bins(n, "size"))


BINS_SQL = with_(
    BASE, POS, SIG, "c AS (SELECT count(*) AS size FROM buckets GROUP BY t, bucket)",
    "p AS (SELECT quantile_cont(size, 0.99) + 1 AS top, least(50, floor(quantile_cont(size, 0.99) + 1))::BIGINT AS bins FROM c)",
    "x AS (SELECT least(floor(size * bins / top), bins - 1)::BIGINT AS bin, count(*) AS n FROM c, p WHERE size <= top GROUP BY ALL)",
    "a AS (SELECT unnest(range(0, bins)) AS bin, top, bins FROM p)",
    select="SELECT bin, round(bin * (top / bins), 6) + 0.0 AS start, round((bin + 1) * (top / bins), 6) AS stop, coalesce(n, 0) AS n FROM a LEFT JOIN x USING (bin)",
)


def window_middles(spark: SparkSession, d: str) -> DataFrame:
    """Half-overlapping windows of 100 positions with their middle and acceptance under the median policy."""
    n = base(spark, d).count()
    log = policies.bucket_occupancy(signed(spark, d).withColumnRenamed("label", "key"), 10).withColumnRenamed("key", "label")
    return _round(reports.midpoints(reports.sliding(log, 100, n), 100, n).select("start", "middle", "acceptance"))


MIDDLES_SQL = with_(BASE, POS, SIG, machine(10, "median"), "w AS (SELECT st AS start, log.* FROM log, (SELECT unnest(range(0, (SELECT count(*) FROM s), 50)) AS st) WHERE pos >= st AND pos < st + 100)", select="SELECT start, (start + least(start + 100, (SELECT count(*) FROM s))) / 2.0::DOUBLE AS middle, round(avg(accepted::INT), 6) AS acceptance FROM w GROUP BY start")

ENTRIES = {
    "policy_budget_sweep": (policy_budget, POLICY_SQL), "occupancy_sweep": (occupancy, OCCUPANCY_SQL), "signature_bits_sweep": (signature_bits, BITS_SQL), "projection_sweep": (projections, JL_SQL),
    "ann_sweep": (ann, ANN_SQL), "duplicate_rate_sweep": (duplicates, DUPLICATES_SQL), "lsh_pq_rerank_topk": (lsh_pq, None), "recall_memory_scatter": (recall_memory, RECALL_MEMORY_SQL), "renamed_report": (renamed, RENAMED_SQL), "budget_report": (by_budget, BUDGET_SQL),
    "occupancy_bins": (occupancy_bins, BINS_SQL), "window_middles": (window_middles, MIDDLES_SQL),
}
