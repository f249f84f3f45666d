"""Exact top-k by matrix products of blocks.

The base is scored one Arrow batch at a time against a matrix of queries, and
each batch returns its own k best of every query, so what is exchanged is k
rows per query and batch. A product of matrices picks the candidates with some
room for rounding; the scores that count are sums in a fixed order, so equal
vectors tie and go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A query set of at most so many bytes is broadcast; a larger one meets the base in tiles of GROUP_ROWS base rows.
BROADCAST_BYTES, GROUP_ROWS = 64 << 20, 100_000
FOUND = "query_id long, item_id long, score double"


def _exact_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return -((q - v) ** 2).sum(1)
    s = (q * v).sum(1)
    return s / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))) if metric == "cosine" else s


def best_of(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, metric: str, others: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, item ids and scores of the k best of each query; with ``others`` an item isn't compared with a query of its own id."""
    out = []
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = q / np.sqrt((q * q).sum(1, keepdims=True)), v / np.sqrt((v * v).sum(1, keepdims=True))
    else:
        a, b = q, v
    size = 0.5 * (b * b).sum(1) if metric == "l2" else 0.0
    room = 1e-9 * (1 + np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)) + np.max(size, initial=0))
    step = max(1, 4_000_000 // max(1, len(ids)))
    for at in range(0, len(asked), step):
        near = a[at : at + step] @ b.T - size
        if others:
            near[asked[at : at + step, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            near_enough = near >= np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k, None] - room
        else:
            near_enough = np.ones(near.shape, bool)
        x, y = np.nonzero(near_enough & (near > -np.inf))
        score = np.concatenate([_exact_scores(q[at + x[i : i + 100_000]], v[y[i : i + 100_000]], metric) for i in range(0, len(x), 100_000)]) if len(x) else np.empty(0)
        order = np.lexsort((ids[y], -score, x))
        x, y, score = x[order], y[order], score[order]
        head = np.concatenate([[True], x[1:] != x[:-1]])
        rank = np.arange(len(x)) - np.maximum.accumulate(np.where(head, np.arange(len(x)), 0))
        out.append((asked[at + x[rank < k]], ids[y[rank < k]], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _shared(queries: DataFrame):
    rows = queries.select("query_id", "q").toArrow()
    asked = rows.column("query_id").to_numpy()
    return queries.sparkSession.sparkContext.broadcast((asked, _matrix(rows.column("q").combine_chunks(), len(asked)) if len(asked) else np.empty((0, 0))))


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "ip", others: bool = False) -> DataFrame:
    """query_id, item_id, score: a superset of the k best of queries (query_id, q) among base (item_id, v), k for each block.

    Rows without a vector take no part; all vectors have one length.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).filter("query_id is not null and q is not null")
    base = base.select(F.col("item_id").cast("long").alias("item_id"), F.col("v").cast("array<double>").alias("v")).filter("item_id is not null and v is not null")
    if (queries.agg(F.sum(8 + 8 * F.size("q"))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = _shared(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    found = best_of(ids, q, batch.column("item_id").to_numpy(), _matrix(batch.column("v"), batch.num_rows), k, metric, others)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "item_id", "score"])

        return base.mapInArrow(run, FOUND)
    groups = max(1, -(-base.count() // GROUP_ROWS))
    blocks = max(1, -(-queries.count() // GROUP_ROWS))
    dealt = base.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wide = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = best_of(left.query_id.to_numpy(), np.stack(left.q), right.item_id.to_numpy(), np.stack(right.v), k, metric, others) if len(left) and len(right) else ([], [], [])
        return pd.DataFrame({"query_id": found[0], "item_id": found[1], "score": found[2]}).astype({"query_id": "int64", "item_id": "int64", "score": "float64"})

    return wide.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInPandas(tile, FOUND)
