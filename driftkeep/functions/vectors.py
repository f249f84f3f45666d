"""Vector arithmetic as Column expressions; everything is computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v if isinstance(v, Column) else F.col(v), lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, floor: float = 1e-12) -> Column:
    """a / max(|a|, floor)."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """A score under which larger is closer: ip, cosine, or l2 as the negative squared distance."""
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    return {"ip": dot, "cosine": cosine, "l2": lambda x, y: -l2_squared(x, y)}[metric](a, b)


def matrix(rows) -> Column:
    """A small constant matrix as an array of arrays."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def project(rows, v: Column) -> Column:
    """Products of each matrix row with a vector."""
    return F.transform(matrix(rows), lambda r: dot(r, v))


def rounded(c: Column, digits: int = 6) -> Column:
    # Adding 0.0 turns a negative zero into zero.
    return F.round(c, digits) + F.lit(0.0)
