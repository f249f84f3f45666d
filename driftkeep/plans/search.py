"""Search queries: exact, coded, bucketed and routed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.functions import hashing
from driftkeep.functions.vectors import normalized, rounded
from driftkeep.operators import knn, streams
from driftkeep.plans.fragments import BASE, BITS, DIM, EVERY, POS, QUERIES, SIG, TABLES, top, with_
from driftkeep.sources.readers import vectors

K = 10


def base(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, f"{d}/embeddings.parquet")


def ask(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))


def stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.positions(base(spark, d), F.col("item_id"))


def signed(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d).withColumn("sig", hashing.simhash_udf(TABLES, BITS, DIM)(F.col("v")))


def show(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "item_id", rounded(F.col("score").cast("double")).alias("score"))


def plain(columns: str = "round(score, 6) + 0.0 AS score") -> str:
    return f"SELECT query_id, rank, item_id, {columns} FROM f"


def exact(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return show(knn.exact(ask(spark, d), base(spark, d), K, metric))

    score = {"ip": "list_inner_product(q.q, e.v)", "cosine": "list_cosine_similarity(q.q, e.v)", "l2": "-list_sum(list_transform(list_zip(q.q, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"}[metric]
    return run, with_(BASE, QUERIES, f"f AS ({top(score, K, 'q, e')})", select=plain())


def dup_sql(rate: float) -> str:
    return f"""n AS (SELECT count(*) AS n, floor(count(*) * {rate}::DOUBLE / (1 - {rate}::DOUBLE))::BIGINT AS extra FROM e),
draws AS (SELECT d, ('0x' || substr(md5('42:' || d::VARCHAR), 1, 8))::BIGINT % n AS src FROM n, (SELECT unnest(range(0, (SELECT extra FROM n))) AS d)),
cp AS (SELECT s.item_id, s.v, s.label, true AS is_dup, d + n AS seq FROM draws JOIN s ON s.pos = src, n),
al AS (SELECT item_id, v, label, false AS is_dup, pos AS seq FROM s UNION ALL SELECT * FROM cp),
dup AS (SELECT item_id, v, label, is_dup, row_number() OVER (ORDER BY ('0x' || substr(md5('43:' || seq::VARCHAR), 1, 8))::BIGINT, seq) - 1 AS pos FROM al)"""


DUP_SQL = dup_sql(0.5)



def unique(spark: SparkSession, d: str) -> DataFrame:
    return show(knn.exact_unique(ask(spark, d), streams.with_duplicates(base(spark, d), 0.5), K))


UNIQUE_SQL = with_(BASE, QUERIES, POS, DUP_SQL, "m AS (SELECT query_id, item_id, max(list_inner_product(q.q, dup.v)) AS sc FROM q, dup GROUP BY ALL)", f"f AS ({top('sc', K, 'm')})", select=plain())


def hamming(spark: SparkSession, d: str) -> DataFrame:
    return show(knn.hamming(ask(spark, d), base(spark, d), K, 64, DIM))


def _codes(name: str, source: str, key: str, vector: str) -> str:
    from driftkeep.functions.hashing import hyperplanes
    from driftkeep.plans.fragments import numbers

    m = numbers(hyperplanes(2, 32, DIM, 7))
    return f"{name} AS (SELECT {key}, list(list_inner_product({vector}, w::DOUBLE[]) > 0 ORDER BY i) AS c FROM {source}, (SELECT unnest({m}) AS w, generate_subscripts({m}, 1) AS i) GROUP BY {key})"


HAMMING_SQL = with_(BASE, QUERIES, _codes("ce", "e", "item_id", "v"), _codes("cq", "q", "query_id", "q.q"), f"f AS ({top('len(list_filter(list_zip(cq.c, ce.c), lambda z: z[1] <> z[2]))', K, 'cq, ce', 'ASC')})", select=plain("score::DOUBLE AS score"))


def fwht(spark: SparkSession, d: str) -> DataFrame:
    z = ask(spark, d).select("query_id", F.posexplode(hashing.fwht(F.col("q"), DIM)).alias("i", "z"))
    return z.select("query_id", F.col("i").cast("long").alias("i"), rounded(F.col("z")).alias("z"))


FWHT_SQL = with_(BASE, QUERIES, select=f"SELECT query_id, i, round(list_sum(list_transform(range(0, {DIM}), lambda j: (CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * q[j + 1])) / sqrt({DIM}.0), 6) + 0.0 AS z FROM q, (SELECT unnest(range(0, {DIM})) AS i)")

LT, LP, LR = 3, 4, 2


def _z(seed: int, source: str, key: str, vector: str) -> str:
    from driftkeep.plans.fragments import numbers

    m = numbers(hashing.rotation(DIM, LR, seed))
    return f"SELECT {key}, {seed - 42} AS tb, i - 1 AS i, list_inner_product({vector}, w::DOUBLE[]) AS z FROM {source}, (SELECT unnest({m}) AS w, generate_subscripts({m}, 1) AS i)"


def _filed(name: str, source: str, key: str, vector: str, n: int) -> str:
    union = " UNION ALL ".join(_z(42 + t, source, key, vector) for t in range(LT))
    return f"z{name} AS ({union}), {name} AS (SELECT {key}, tb, (2 * i + (z < 0)::BIGINT)::BIGINT AS bucket, probe, abs(z) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY {key}, tb ORDER BY abs(z) DESC, i) AS probe FROM z{name}) WHERE probe <= {n})"


def cross_polytope(spark: SparkSession, d: str) -> DataFrame:
    each = [F.struct(F.lit(t).cast("long").alias("t"), hashing.cross_polytope(hashing.rotated(F.col("v"), DIM, LR, 42 + t)).alias("b")) for t in range(LT)]
    return base(spark, d).select("item_id", F.explode(F.array(*each)).alias("x")).select("item_id", F.col("x.t").alias("tb"), F.col("x.b").alias("bucket"))


CROSS_SQL = with_(BASE, _filed("fe", "e", "item_id", "v", 1), select="SELECT item_id, tb::BIGINT AS tb, bucket FROM fe")


def probe_sequence(spark: SparkSession, d: str) -> DataFrame:
    return ask(spark, d).select("query_id", F.posexplode(hashing.probes(hashing.rotated(F.col("q"), DIM, LR, 42), LP)).alias("p", "bucket")).select("query_id", (F.col("p") + 1).cast("long").alias("probe"), "bucket")


PROBE_SQL = with_(BASE, QUERIES, _filed("fq", "q", "query_id", "q.q", LP), select="SELECT query_id, probe, bucket FROM fq WHERE tb = 0")
_CAND = ", ".join([_filed("fe", "e", "item_id", "v", 1), _filed("fq", "q", "query_id", "q.q", LP), "c AS (SELECT DISTINCT query_id, item_id FROM fq JOIN fe USING (tb, bucket))", "cv AS (SELECT c.query_id, c.item_id, q.q AS qv, e.v FROM c JOIN q USING (query_id) JOIN e USING (item_id))"])
_L2 = "-list_sum(list_transform(list_zip(qv, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def multiprobe(spark: SparkSession, d: str) -> DataFrame:
    return show(knn.multiprobe(ask(spark, d), base(spark, d), K, DIM, tables=LT, n_probes=LP))


def multiprobe_rerank(spark: SparkSession, d: str) -> DataFrame:
    return show(knn.multiprobe(ask(spark, d), base(spark, d), K, DIM, rerank=15, tables=LT, n_probes=LP))


MULTI_SQL = with_(BASE, QUERIES, _CAND, f"f AS ({top(_L2, K, 'cv')})", select=plain())
RERANK_SQL = with_(BASE, QUERIES, _CAND, "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(qv, v) DESC, item_id) AS n FROM cv) WHERE n <= 15)", f"f AS ({top(_L2, K, 'b')})", select=plain())


CAP, ALPHA = 50, 0.1


def multi_index(spark: SparkSession, d: str) -> DataFrame:
    """Top-k from a thinned index: items under two buckets, a bucket keeps the 50 nearest to its axis or a tenth, if that is more."""
    return show(knn.multiprobe(ask(spark, d), base(spark, d), K, DIM, tables=LT, n_probes=LP, base_probes=2, bucket_cap=CAP, alpha=ALPHA))


def total_probes(spark: SparkSession, d: str) -> DataFrame:
    """Top-k with a budget of probes over all tables."""
    return show(knn.multiprobe(ask(spark, d), base(spark, d), K, DIM, tables=LT, total_probes=LT * LP))


_CV = "cv AS (SELECT c.query_id, c.item_id, q.q AS qv, e.v FROM c JOIN q USING (query_id) JOIN e USING (item_id))"
MULTI_INDEX_SQL = with_(
    BASE, QUERIES, _filed("fe", "e", "item_id", "v", 2), _filed("fq", "q", "query_id", "q.q", LP),
    f"cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tb, bucket ORDER BY strength DESC, item_id) AS n, count(*) OVER (PARTITION BY tb, bucket) AS m FROM fe) WHERE n <= greatest({CAP}, ceil(m * {ALPHA}::DOUBLE)))",
    "c AS (SELECT DISTINCT query_id, item_id FROM fq JOIN cap USING (tb, bucket))", _CV, f"f AS ({top(_L2, K, 'cv')})", select=plain(),
)
TOTAL_SQL = with_(
    BASE, QUERIES, _filed("fe", "e", "item_id", "v", 1), _filed("fa", "q", "query_id", "q.q", 2 * DIM),
    f"fq AS (SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY probe > 1, strength DESC, tb, probe) <= {LT * LP})",
    "c AS (SELECT DISTINCT query_id, item_id FROM fq JOIN fe USING (tb, bucket))", _CV, f"f AS ({top(_L2, K, 'cv')})", select=plain(),
)


def routed(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d).withColumnRenamed("label", "region")
    return show(knn.routed(ask(spark, d), b, knn.mean_centroids(b), K, 3))


ROUTED_SQL = with_(
    BASE, QUERIES,
    "m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY ALL)",
    "ct AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)",
    "rt AS (SELECT * FROM (SELECT query_id, q.q AS qv, label, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(q.q, c) DESC, label) AS n FROM q, ct) WHERE n <= 3)",
    "hit AS (SELECT query_id, qv, item_id, v FROM rt JOIN e USING (label))",
    f"f AS ({top('list_inner_product(qv, v)', K, 'hit')})", select=plain(),
)
PM, PC = 8, 16


def pq(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    books = knn.pq_codebooks(b, PM, DIM, PC)
    return show(knn.pq_search(ask(spark, d), b, books, K))


_W = DIM // PM
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
PQ_SQL = with_(
    BASE, QUERIES,
    f"cb AS (SELECT row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || item_id::VARCHAR), 1, 8))::BIGINT, item_id) - 1 AS code, v FROM e ORDER BY code LIMIT {PC})",
    f"bk AS (SELECT m, code, v[m * {_W} + 1 : m * {_W} + {_W}] AS w FROM cb, (SELECT unnest(range(0, {PM})) AS m))",
    f"en AS (SELECT item_id, m, code FROM (SELECT item_id, m, code, row_number() OVER (PARTITION BY item_id, m ORDER BY {_SQ.format(a=f'v[m * {_W} + 1 : m * {_W} + {_W}]', b='w')}, code) AS n FROM e, bk) WHERE n = 1)",
    f"lt AS (SELECT query_id, m, code, {_SQ.format(a=f'q.q[m * {_W} + 1 : m * {_W} + {_W}]', b='w')} AS dist FROM q, bk)",
    "sc AS (SELECT query_id, item_id, round(sum(dist), 9) AS sc FROM en JOIN lt USING (m, code) GROUP BY ALL)",
    f"f AS ({top('sc', K, 'sc', 'ASC')})", select=plain(),
)


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = knn.signature_pairs(signed(spark, d), TABLES, 0.3)
    return p.select("a", "b", "n_a", "n_b", rounded(F.col("jaccard")).alias("jaccard"))


def jaccard_classes(spark: SparkSession, d: str) -> DataFrame:
    return knn.signature_classes(signed(spark, d))


_CLASSES = "cl AS (SELECT sig, min(pos) AS rep, count(*) AS n FROM g GROUP BY sig)"
JACCARD_SQL = with_(
    BASE, POS, SIG, _CLASSES, "x AS (SELECT rep, n, unnest(sig) AS b, generate_subscripts(sig, 1) AS t FROM cl)",
    "p AS (SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS m FROM x JOIN x y ON x.t = y.t AND x.b = y.b AND x.rep < y.rep GROUP BY x.rep, y.rep)",
    select=f"SELECT a, b, n_a, n_b, round(m / ({2 * TABLES} - m), 6) AS jaccard FROM p WHERE m / ({2 * TABLES} - m) >= 0.3",
)
CLASSES_SQL = with_(BASE, POS, SIG, _CLASSES, select="SELECT pos, rep FROM g JOIN cl USING (sig)")


def simhash(spark: SparkSession, d: str) -> DataFrame:
    return signed(spark, d).select("pos", F.posexplode("sig").alias("t", "bucket")).select("pos", F.col("t").cast("long").alias("t"), "bucket")


SIMHASH_SQL = with_(BASE, POS, SIG, select="SELECT pos, t::BIGINT AS t, bucket FROM buckets")


def normalize(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("item_id", F.posexplode(normalized(F.transform("v", lambda x: x * 3.0))).alias("i", "x")).select("item_id", F.col("i").cast("long").alias("i"), rounded(F.col("x")).alias("x"))


NORMALIZE_SQL = with_(BASE, select="SELECT item_id, generate_subscripts(v, 1) - 1 AS i, round(unnest(list_transform(v, lambda x: 3.0 * x / greatest(sqrt(list_sum(list_transform(v, lambda y: 9.0 * y * y))), 1e-12))), 6) + 0.0 AS x FROM e")


def center(spark: SparkSession, d: str) -> DataFrame:
    return streams.centred(base(spark, d)).select("item_id", F.posexplode("v").alias("i", "x")).select("item_id", F.col("i").cast("long").alias("i"), rounded(F.col("x")).alias("x"))


CENTER_SQL = with_(BASE, "x AS (SELECT item_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM e)", select="SELECT item_id, i, round(x - avg(x) OVER (PARTITION BY i), 6) + 0.0 AS x FROM x")


def jl(spark: SparkSession, d: str) -> DataFrame:
    return streams.jl_projected(base(spark, d), DIM, 16).select("item_id", F.posexplode("v").alias("i", "x")).select("item_id", F.col("i").cast("long").alias("i"), rounded(F.col("x")).alias("x"))


def _jl_sql() -> str:
    from driftkeep.plans.fragments import numbers

    m = numbers(streams.jl_matrix(DIM, 16))
    return with_(BASE, f"p AS (SELECT item_id, i - 1 AS i, list_inner_product(v, w::DOUBLE[]) AS y FROM e, (SELECT unnest({m}) AS w, generate_subscripts({m}, 1) AS i))", select="SELECT item_id, i, round(y / sqrt(sum(y * y) OVER (PARTITION BY item_id)), 6) + 0.0 AS x FROM p")


def spot_check(spark: SparkSession, d: str) -> DataFrame:
    truth = knn.exact(ask(spark, d), base(spark, d), K)
    return knn.spot_check(truth, knn.multiprobe(ask(spark, d), base(spark, d), K, DIM, tables=LT, n_probes=LP), K)


SPOT_SQL = with_(BASE, QUERIES, _CAND, f"t AS ({top('list_inner_product(q.q, e.v)', K, 'q, e')})", f"f AS ({top(_L2, K, 'cv')})", select=f"SELECT q.query_id, count(f.item_id) / {K}.0::DOUBLE AS overlap FROM q LEFT JOIN t ON t.query_id = q.query_id LEFT JOIN f ON f.query_id = t.query_id AND f.item_id = t.item_id GROUP BY q.query_id")

ENTRIES = {f"knn_{m}_topk": exact(m) for m in ("ip", "l2", "cosine")} | {
    "knn_unique_topk": (unique, UNIQUE_SQL), "hamming_topk": (hamming, HAMMING_SQL), "fwht": (fwht, FWHT_SQL), "cross_polytope_hash": (cross_polytope, CROSS_SQL), "probe_sequence": (probe_sequence, PROBE_SQL),
    "multiprobe_topk": (multiprobe, MULTI_SQL), "multiprobe_rerank_topk": (multiprobe_rerank, RERANK_SQL), "multi_index_probe": (multi_index, MULTI_INDEX_SQL), "total_probe_topk": (total_probes, TOTAL_SQL), "ivf_topk": (routed, ROUTED_SQL), "pq_adc_topk": (pq, PQ_SQL),
    "signature_jaccard_pairs": (jaccard_pairs, JACCARD_SQL), "signature_classes": (jaccard_classes, CLASSES_SQL), "simhash_signature": (simhash, SIMHASH_SQL), "normalize_vectors": (normalize, NORMALIZE_SQL), "center_vectors": (center, CENTER_SQL), "jl_project": (jl, _jl_sql()), "knn_spot_check": (spot_check, SPOT_SQL),
}
