"""Queries through sources and sinks: what is written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.functions.vectors import rounded, total
from driftkeep.plans.fragments import BASE, POS, h, with_
from driftkeep.plans.reporting import GRID_SQL, budget_grid
from driftkeep.plans.search import stream
from driftkeep.sources import readers
from driftkeep.sources.staging import new_folder


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("passages"))


_ROWS = "pa AS (SELECT doc_id AS id, trim(unnest(string_split(text, chr(10)))) AS text FROM documents)"


def passages(spark: SparkSession, d: str) -> DataFrame:
    return readers.passages(_rows(spark, d))


def unique_passages(spark: SparkSession, d: str) -> DataFrame:
    return readers.passages(_rows(spark, d), unique=True)


def sampled_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages of a hundred rows, drawn without replacement."""
    return readers.sampled_passages(_rows(spark, d), 100)


PASSAGES_SQL = with_(_ROWS, select="SELECT id, text FROM pa WHERE text <> ''")
UNIQUE_SQL = with_(_ROWS, select="SELECT min(id) AS id, text FROM pa WHERE text <> '' GROUP BY text")
SAMPLED_SQL = with_(_ROWS, select=f"SELECT id, text FROM pa WHERE text <> '' AND id IN (SELECT doc_id FROM documents ORDER BY {h('doc_id', 42)}, doc_id LIMIT 100)")


def csv_results(spark: SparkSession, d: str) -> DataFrame:
    """The budget grid, appended to a result folder cell by policy and scanned again."""
    folder = new_folder(spark, "results-csv")
    grid = budget_grid(spark, d)
    readers.append_csv(grid.filter("policy = 'FIFO'"), folder, "overwrite")
    readers.append_csv(grid.filter("policy <> 'FIFO'"), folder)
    return readers.results_csv(spark, folder, "policy string, fraction double, capacity long")


def split_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each policy's own folder."""
    folder = new_folder(spark, "results-split")
    readers.split_by(budget_grid(spark, d), folder, "policy")
    return spark.read.parquet(folder).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


SPLIT_SQL = f"SELECT policy, count(*) AS n FROM ({GRID_SQL}) GROUP BY policy"


def npy(spark: SparkSession, d: str) -> DataFrame:
    """pos, length and sum of vectors written as .npy matrices and read back."""
    folder = new_folder(spark, "npy")
    name = lambda c: F.substring_index(c, "/", -1)
    written = readers.write_npy(stream(spark, d), folder).select(name("path").alias("file"), "first_pos")
    read = readers.npy_vectors(spark, f"{folder}/*.npy").withColumn("file", name("path"))
    back = read.join(F.broadcast(written), "file")
    return back.select((F.col("first_pos") + F.col("pos")).alias("pos"), F.size("v").cast("long").alias("length"), rounded(total(F.col("v"))).alias("sum"))


NPY_SQL = with_(BASE, POS, select="SELECT pos, len(v) AS length, round(list_sum(v), 6) + 0.0 AS sum FROM s")

ENTRIES = {
    "passages_scan": (passages, PASSAGES_SQL), "passages_unique": (unique_passages, UNIQUE_SQL), "passages_sample": (sampled_passages, SAMPLED_SQL),
    "csv_results": (csv_results, GRID_SQL), "split_results": (split_results, SPLIT_SQL), "npy_vectors": (npy, NPY_SQL),
}
