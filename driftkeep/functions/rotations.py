"""Rotations fitted on a bounded sample: principal axes and the quantising rotation of sign codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkeep.functions.hashing import hash32
from driftkeep.functions.vectors import project

SAMPLE = 20_000


def sample(base: DataFrame, rows: int = SAMPLE, salt: int = 5) -> np.ndarray:
    """Vectors of about ``rows`` items, by hash."""
    share = min(1.0, rows / max(1, base.count()))
    return np.array([r.v for r in base.filter(hash32("item_id", salt) < F.lit(int(share * 2**32))).select("v").collect()])


def principal_axes(x: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``to`` axes of largest variance, each with its largest entry positive."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:to]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * signs[:, None]


def quantising_rotation(x: np.ndarray, rounds: int = 50, seed: int = 42) -> np.ndarray:
    """The rotation that brings centred rows nearest to the corners of a cube, by alternating sign and Procrustes steps."""
    r, _ = np.linalg.qr(np.random.RandomState(seed).randn(x.shape[1], x.shape[1]))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def reduced(base: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """The vectors minus the mean, on given axes."""
    shift = F.array(*[F.lit(float(m)) for m in mean])
    return base.withColumn("v", project(axes, F.zip_with("v", shift, lambda x, m: x - m)))
