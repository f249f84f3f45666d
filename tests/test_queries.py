"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from driftkeep.functions import hashing
from driftkeep.operators import metrics, policies, reports
from driftkeep.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([tuple(value(r[c]) for c in cols) for r in df.collect()], key=str)
    q = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    assert got == sorted([tuple(value(r[names.index(c)]) for c in cols) for r in q.fetchall()], key=str)


def test_capacity_edges(spark):
    s = spark.createDataFrame([(i, i) for i in range(4)], "pos long, item_id long")
    assert [policies.fifo(s, b).count() for b in (1, 4, 9)] == [1, 4, 4]
    assert {r.pos for r in policies.fifo(s, 2).collect()} == {2, 3}
    with pytest.raises(ValueError):
        policies.fifo(s, 0)


def test_empty_kept_set(spark):
    none = spark.createDataFrame([], "item_id long, v array<double>")
    probe = spark.createDataFrame([(0, [1.0, 0.0])], "item_id long, v array<double>")
    assert metrics.k_center_radius(probe, none).first()[0] == math.inf
    assert metrics.cosine_radius(probe, none).first()[0] == 2.0


def test_pareto_ties(spark):
    df = spark.createDataFrame([("a", 0.9, 5.0), ("b", 0.9, 5.0), ("c", 0.5, 4.0), ("d", 0.5, 9.0)], "m string, recall double, qps double")
    assert {r.m for r in reports.pareto(df).collect()} == {"a", "b", "d"}


def test_walsh_hadamard_keeps_length(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(hashing.fwht(F.col("v"), 4).alias("z")).first()
    assert sum(x * x for x in row.z) == pytest.approx(30.0) and row.z[0] == pytest.approx(5.0)
