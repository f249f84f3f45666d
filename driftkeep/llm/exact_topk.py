"""Exact top-k inner-product search by tiled matrix products.

Base rows are dealt to R groups and queries to C groups. Each of the R x C
tiles is one matrix product of bounded size with a partial selection of k per
query; the lists of a query are then merged in a tree of FAN-way merges. Work
per task and rows per key are bounded at every size.

Vectors are quantised as floor(scale * x), x as double; scores are exact
integers (Python integers where doubles could round, saturated to long).

Defined results: vectors that are null, or hold a null, NaN or infinity, take
no part. Vectors of unequal length are compared over zero-padded components.
Each query row has a list of its own, repeated ids included; only the row
itself is left out of it. Ties go to the smaller vec_id, null ids last. A null
vec_id is never a query. No query or no candidate gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import stash
from driftkeep.llm.tables import table

#: Base rows and queries of a tile, partial lists that one merge takes.
BASE_ROWS, QUERY_ROWS, FAN = 8192, 8192, 16
_BOUND = 1 << 53
_LONG = (1 << 63) - 1
_LISTS = "q_row long, q_id long, r int, missing boolean, vec_id long, score long"


def _matrix(raw: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim))
    for i, x in enumerate(raw):
        out[i, : len(x)] = x
    return out


def _scores(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no sum can reach 2**53."""
    if not len(q) or not len(b):
        return np.zeros((len(q), len(b)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(b).max(initial=0) * max(1, q.shape[1]) < _BOUND:
        return (q @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = big(q) @ big(b).T
    return np.array([[max(-_LONG - 1, min(_LONG, int(x))) for x in row] for row in exact], np.int64).reshape(len(q), len(b))


def _tile(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q_row", "q_id", "r", "missing", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        dim = max(left.v.map(len).max(), right.v.map(len).max(), 1)
        base, rows, ids, missing = _matrix(left.v, dim), left.row.to_numpy(), left.vec_id.to_numpy(), left.missing.to_numpy()
        rank = np.lexsort((rows, ids, missing))
        base, rows, ids, missing = base[rank], rows[rank], ids[rank], missing[rank]  # candidates in tie order
        q_rows, q_ids, out = right.row.to_numpy(), right.vec_id.to_numpy(), []
        for at in range(0, len(right), 256):
            s = _scores(_matrix(right.v.iloc[at : at + 256], dim), base)
            own = q_rows[at : at + 256, None] == rows[None, :]
            # Everything at or above the k-th score, then in tie order: a partial selection that loses no tie.
            near = ~own
            if len(base) > k + 1:
                near &= s >= np.partition(s, len(base) - k - 1, axis=1)[:, len(base) - k - 1, None]
            x, y = np.nonzero(near)
            score = s[x, y]
            order = np.lexsort((y, ~score, x))
            x, y, score = x[order], y[order], score[order]
            head = np.concatenate([[True], x[1:] != x[:-1]])
            first = np.arange(len(x)) - np.maximum.accumulate(np.where(head, np.arange(len(x)), 0)) < k
            x, y = at + x[first], y[first]
            out.append(pd.DataFrame(dict(zip(names, (q_rows[x], q_ids[x], np.full(len(x), left.r.iloc[0]), missing[y], ids[y], score[first]), strict=True))))
        return pd.concat(out)

    return best


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Quantised vectors that take part, with a row number of their own."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")).filter(F.col("embedding").isNotNull() & ~bad).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("missing"), "row", F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("double")).alias("v"))


def exact_topk(vectors: DataFrame, k: int = 5, scale: int = 256, query_modulus: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row whose id the modulus divides."""
    rows = stash(usable(vectors, scale), "topk-rows")
    is_query = ~F.col("missing") & (F.col("vec_id") % query_modulus == 0)
    n, n_q = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    r_groups, c_groups = max(1, -(-n // BASE_ROWS)), max(1, -(-n_q // QUERY_ROWS))
    deal = lambda groups, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)).cast("int")
    base = rows.withColumn("r", deal(r_groups, 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_groups - 1))))
    # New names for the query side: a cogroup of one table with itself mixes up its columns.
    queries = rows.filter(is_query).select(*[F.col(x).alias(x) for x in ("vec_id", "missing", "row", "v")]).withColumn("c", deal(c_groups, 2)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r_groups - 1))))
    lists = base.groupBy("r", "c").cogroup(queries.groupBy("r", "c")).applyInPandas(_tile(k), _LISTS)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "missing", "vec_id"))), 1, k)
    merged = lists
    while r_groups > 1:
        r_groups = -(-r_groups // FAN)
        merged = merged.groupBy("q_row", "q_id", F.floor(F.col("r") / FAN).cast("int").alias("r")).agg(best.alias("top")).select("q_row", "q_id", "r", F.explode("top").alias("t")).select("q_row", "q_id", "r", "t.missing", "t.vec_id", (-F.col("t.s")).alias("score"))
    one = merged.groupBy("q_row", "q_id").agg(best.alias("top")).select(F.col("q_id").alias("query_id"), F.posexplode("top").alias("at", "t"))
    return one.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(~F.col("t.missing"), F.col("t.vec_id")).alias("vec_id"), (-F.col("t.s")).alias("score"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
