"""Product quantisation: codebooks by k-means, asymmetric distances, exact scores of the best.

Codebooks are fitted on a seeded hash sample of at most ``sample`` vectors and
are as large at any size of the base; every vector is encoded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkeep.operators import knn
from driftkeep.operators.metrics import hash_sample


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit_codebooks(base: DataFrame, parts: int = 32, codes: int = 256, sample: int = 20_000, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """(parts, codes, width): k-means of each part of the sampled vectors; fewer codes if there are fewer vectors."""
    rows = hash_sample(base.filter("v is not null"), sample, seed).select("v").collect()
    if not rows:
        raise ValueError("no vectors to fit on")
    x = np.array([r.v for r in rows])
    if x.shape[1] % parts:
        raise ValueError("parts must divide the dimension")
    rng = np.random.default_rng(seed)
    return np.stack([_k_means(p, codes, rounds, rng) for p in np.split(x, parts, axis=1)])


def encode(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes of the rows: the nearest codeword of each part."""
    parts = np.split(vectors, len(books), axis=1)
    return np.stack([((b * b).sum(1) - 2 * p @ b.T).argmin(1) for p, b in zip(parts, books, strict=True)], 1)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], axis=1)


def search(queries: DataFrame, base: DataFrame, books: np.ndarray, k: int, dim: int, metric: str = "l2", rerank: int = 100, **index) -> DataFrame:
    """Top-k of queries: bucket candidates, the ``rerank`` nearest of them to their codes, exact scores of those."""
    near = knn.by_buckets(queries, base, rerank, dim, "l2", metric, lambda v: decode(encode(v, books), books), **index)
    return knn.top_k(near.select("query_id", "item_id", F.col("more").alias("score")), k)
