"""Measured runs: latency and recall of a search function, throughput of a policy, bytes of an index."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

RESULT = "recall double, qps double, p50_us double, p95_us double, p99_us double, mean_us double, n_queries long, warmup long"


def benchmark(search: Callable[[np.ndarray, int], Sequence[int]], queries: np.ndarray, truth: Sequence[Sequence[int]], k: int = 10, warmup: int = 100) -> dict[str, float]:
    """One result row of a bounded query set, asked one at a time after a warm-up."""
    if len(queries) != len(truth):
        raise ValueError("as many true lists as queries are needed")
    for q in queries[:warmup]:
        search(q, k)
    took, hits = [], []
    for q, t in zip(queries, truth, strict=True):
        began = time.perf_counter_ns()
        found = search(q, k)
        took.append(time.perf_counter_ns() - began)
        hits.append(len(set(found[:k]) & set(t[:k])) / k)
    us = np.array(took) / 1000
    p = np.percentile(us, [50, 95, 99])
    return {"recall": float(np.mean(hits)), "qps": 1e6 / float(us.mean()), "p50_us": float(p[0]), "p95_us": float(p[1]), "p99_us": float(p[2]), "mean_us": float(us.mean()), "n_queries": len(queries), "warmup": min(warmup, len(queries))}


def policy_run(log: DataFrame) -> dict[str, float]:
    """Items, accepted, share and items a second of computing a decision log."""
    began = time.perf_counter()
    n, accepted = log.selectExpr("count(*)", "sum(int(accepted))").first()
    seconds = time.perf_counter() - began
    return {"items": n, "accepted": accepted or 0, "acceptance": (accepted or 0) / max(n, 1), "items_per_second": n / seconds}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written index, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
