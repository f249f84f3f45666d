"""Command line: list queries, run one, exact neighbours of files, keep a budget of a stream, summarise result files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.functions.hashing import simhash
from driftkeep.operators import knn, registry, streams
from driftkeep.plans.registry import QUERIES
from driftkeep.sources import readers


def write(df: DataFrame, path: str, form: str) -> None:
    df.write.mode("overwrite").options(**({"header": "true"} if form == "csv" else {})).format(form).save(path)


def ground_truth(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The k nearest base rows of every query row."""
    asked = readers.vectors(spark, a.query, a.id, a.vector).select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return knn.exact(asked, readers.vectors(spark, a.base, a.id, a.vector), a.k, a.metric)


def keep(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What a policy keeps of a table of vectors, taken in order of their ids as one stream."""
    stream = streams.positions(readers.vectors(spark, a.base, a.id, a.vector), F.col("item_id")).withColumn("key", F.lit(0).cast("long"))
    if a.policy == "bucket_occupancy":
        dim = len(stream.first().v)
        stream = stream.withColumn("sig", simhash(F.col("v"), a.tables, a.bits, dim))
    return registry.policy(a.policy)(stream, a.capacity).select("pos", "item_id")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftkeep", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("--data", required=True)
    truth = sub.add_parser("ground-truth")
    truth.add_argument("--query", required=True)
    truth.add_argument("--metric", choices=("ip", "l2", "cosine"), default="ip")
    truth.add_argument("--k", type=int, default=100)
    kept = sub.add_parser("keep")
    kept.add_argument("--policy", choices=registry.names(), required=True)
    kept.add_argument("--capacity", type=int, required=True)
    kept.add_argument("--tables", type=int, default=8)
    kept.add_argument("--bits", type=int, default=10)
    for x in (truth, kept):
        x.add_argument("--base", required=True)
        x.add_argument("--id", default="vec_id")
        x.add_argument("--vector", default="embedding")
    for x in (run, truth, kept):
        x.add_argument("--output", required=True)
        x.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    summary = sub.add_parser("summarize")
    summary.add_argument("--results", required=True, help="glob of JSON metric files")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run a command; returns what it prints."""
    a = parser().parse_args(argv)
    if a.command == "list":
        return "\n".join(sorted(QUERIES))
    spark = spark or SparkSession.builder.appName("driftkeep").getOrCreate()
    if a.command == "summarize":
        return readers.markdown(readers.method_results(spark, a.results))
    df = {"run": lambda: QUERIES[a.query](spark, a.data), "ground-truth": lambda: ground_truth(spark, a), "keep": lambda: keep(spark, a)}[a.command]()
    write(df, a.output, a.format)
    return a.output


if __name__ == "__main__":
    print(main())
