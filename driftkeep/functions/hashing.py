"""Seeded hashes, hyperplane signatures, Walsh-Hadamard rotations and bucket probes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftkeep.functions.vectors import dot, project


def hash32(c: Column | str, salt: int) -> Column:
    """An integer below 2**32 from the md5 of "salt:value", equal in other engines."""
    value = (c if isinstance(c, Column) else F.col(c)).cast("string")
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), value)), 1, 8), 16, 10).cast("long")


def hash01(c: Column | str, salt: int) -> Column:
    return hash32(c, salt) / F.lit(float(1 << 32))


@lru_cache(16)
def hyperplanes(tables: int, bits: int, dim: int, seed: int = 42) -> np.ndarray:
    return np.random.RandomState(seed).randn(tables * bits, dim).astype(np.float32).astype(np.float64)


def simhash(v: Column, tables: int, bits: int, dim: int, seed: int = 42) -> Column:
    """One bucket per table: the signs of ``bits`` projections, first bit most significant."""
    planes = hyperplanes(tables, bits, dim, seed)
    signs = F.transform(project(planes, v), lambda p: (p > 0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.aggregate(F.slice(signs, t * bits + 1, bits), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b))


def simhash_udf(tables: int, bits: int, dim: int, seed: int = 42):
    """The same signature by one matrix product per Arrow batch, for wide matrices."""
    planes = hyperplanes(tables, bits, dim, seed)

    @F.pandas_udf("array<long>", F.PandasUDFType.SCALAR)
    def signature(vectors):
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        signs = (np.stack([np.asarray(x, np.float64) for x in vectors]) @ planes.T > 0).reshape(len(vectors), tables, bits)
        return pd.Series(list(signs @ (1 << np.arange(bits - 1, -1, -1))))

    return signature


def code_words(v: Column, n_bits: int, dim: int, seed: int = 7) -> Column:
    """Sign bits packed into longs of 32 bits each."""
    return simhash(v, n_bits // 32, 32, dim, seed)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)


def power_of_two(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def fwht(v: Column, dim: int) -> Column:
    """Normalised Walsh-Hadamard transform in closed form; dim is a power of two."""
    index = F.sequence(F.lit(0), F.lit(dim - 1))
    sign = lambda i, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.transform(index, lambda i: dot(F.transform(index, lambda j: sign(i, j)), v) / F.lit(float(np.sqrt(dim))))


@lru_cache(64)
def rotation_signs(dim: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (rotations, power_of_two(dim)))


@lru_cache(64)
def rotation(dim: int, rotations: int, seed: int) -> np.ndarray:
    """All sign flips and transforms of a table folded into one matrix."""
    full = power_of_two(dim)
    i = np.arange(full)
    bits = np.array([[bin(a & b).count("1") for b in i] for a in i])
    had = np.where(bits % 2 == 0, 1.0, -1.0) / np.sqrt(full)
    out = np.eye(full)
    for s in rotation_signs(dim, rotations, seed):
        out = had @ np.diag(s) @ out
    return out[:, :dim]


def rotated(v: Column, dim: int, rotations: int, seed: int) -> Column:
    return project(rotation(dim, rotations, seed), v)


def probes(z: Column, n: int) -> Column:
    """Buckets of the n largest coordinates by magnitude, each with its own sign; the first is the hash."""
    pairs = F.transform(z, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.cast("long").alias("i"), (x < 0).cast("long").alias("s")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["i"] * 2 + p["s"])


def cross_polytope(z: Column) -> Column:
    return F.element_at(probes(z, 1), 1)


def probe_udf(dim: int, tables: int, rotations: int, seed: int, n: int):
    """Buckets of every table: array<struct<table, bucket, probe, strength>>, n probes a table, one matrix product per Arrow batch and table."""

    @F.pandas_udf("array<struct<table: int, bucket: bigint, probe: int, strength: double>>", F.PandasUDFType.SCALAR)
    def buckets(vectors):
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, np.float64) for v in vectors])
        found = []
        for t in range(tables):
            z = x @ rotation(dim, rotations, seed + t).T
            near = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :n]
            at = np.take_along_axis(z, near, 1)
            found.append((2 * near + (at < 0), np.abs(at)))
        return pd.Series([[{"table": t, "bucket": b, "probe": p, "strength": s} for t in range(tables) for p, (b, s) in enumerate(zip(found[t][0][i].tolist(), found[t][1][i].tolist(), strict=True))] for i in range(len(x))])

    return buckets
