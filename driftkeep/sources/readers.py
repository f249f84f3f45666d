"""Sources and sinks: vectors, NPY arrays, passages, conversations, result tables."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkeep.functions.hashing import hash32
from driftkeep.functions.vectors import doubles, normalized
from driftkeep.sources.files import open_file

#: A conversation file: sessions by name, each a list of turns, and questions.
TURN = T.StructType([T.StructField(x, T.StringType()) for x in ("speaker", "text", "dia_id")])
QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("category", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
DIALOGUE = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("conversation", T.MapType(T.StringType(), T.StringType())), T.StructField("qa", T.ArrayType(QA))])


def vectors(spark: SparkSession, path: str, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """item_id, v (doubles), label of a parquet table of vectors."""
    df = spark.read.parquet(path)
    label = F.col("label").cast("long") if "label" in df.columns else F.lit(None).cast("long")
    return df.select(F.col(id_column).alias("item_id"), doubles(vector_column).alias("v"), label.alias("label"))


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, pos (row of its file) and v of .npy matrices; each file is one task, rows stream out in blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(a), 4096):
                    yield pd.DataFrame({"path": name, "pos": np.arange(at, min(at + 4096, len(a))), "v": list(a[at : at + 4096].astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, pos long, v array<double>")


def write_npy(df: DataFrame, folder: str, column: str = "v") -> DataFrame:
    """path, first_pos and n_rows of .npy matrices, one for each range of ``pos``, each in its order and written by its own task.

    A repeated task writes a file of its own; those that count are listed in what is returned, which is kept in the folder.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ctx, held = TaskContext.get(), []
        for pdf in batches:
            held.append((pdf.pos.to_numpy(), np.stack(pdf[column]) if len(pdf) else np.empty((0, 0))))
        held = [x for x in held if len(x[0])]
        if held:
            path = f"{folder}/vectors-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.npy"
            content = io.BytesIO()
            np.save(content, np.concatenate([v for _, v in held]))
            with open_file(path, "wb") as f:
                f.write(content.getvalue())
            yield pd.DataFrame({"path": [path], "first_pos": [held[0][0][0]], "n_rows": [sum(len(p) for p, _ in held)]})

    spark = df.sparkSession
    ranges = df.select("pos", column).repartitionByRange("pos").sortWithinPartitions("pos")
    spark.createDataFrame([], "x int").write.mode("ignore").parquet(folder)  # makes the folder, by Spark's own file system
    ranges.mapInPandas(write, "path string, first_pos long, n_rows long").write.parquet(f"{folder}/written")
    return spark.read.parquet(f"{folder}/written")


def sampled_passages(df: DataFrame, n: int, column: str = "passages", salt: int = 42) -> DataFrame:
    """The passages of n rows drawn without replacement, by the smallest seeded hash of the row id."""
    return passages(df.orderBy(hash32("id", salt), "id").limit(n), column)


def passages(df: DataFrame, column: str = "passages", limit: int | None = None, unique: bool = False) -> DataFrame:
    """Trimmed, non-empty passages of an array column, in order of the row id, or each distinct one once."""
    out = df.select("id", F.posexplode(column).alias("i", "p")).select("id", "i", F.trim(F.coalesce("p", F.lit(""))).alias("text")).filter("text <> ''")
    if unique:
        out = out.groupBy("text").agg(F.min("id").alias("id"), F.lit(0).alias("i"))
    out = out.orderBy("id", "i", "text") if limit is not None else out
    return (out.limit(limit) if limit is not None else out).select("id", "text")


def embed(df: DataFrame, text: str = "text", dim: int = 64, out: str = "v") -> DataFrame:
    """A hashing-trick embedding: words counted by md5 slot, normalised; stands in for a text model."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")

    @F.pandas_udf("array<double>")
    def counts(column: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def slot(w: str) -> int:
            if w not in known:
                if len(known) > 100_000:
                    known.clear()
                known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
            return known[w]

        return pd.Series([np.bincount([slot(w) for w in ws], minlength=dim).astype(np.float64) if len(ws) else np.zeros(dim) for ws in column])

    return df.withColumn("__v", counts(words)).withColumn(out, normalized(F.col("__v"))).drop("__v")


def dialogue_turns(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, session, turn, speaker, text: sessions in numeric order, blank turns dropped."""
    raw = spark.read.schema(DIALOGUE).json(path, multiLine=True)
    sessions = raw.select("sample_id", F.explode("conversation").alias("name", "body")).filter(F.col("name").rlike("^session_[0-9]+$"))
    turns = sessions.select("sample_id", F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("session"), F.posexplode(F.from_json("body", T.ArrayType(TURN))).alias("turn", "t"))
    return turns.filter(F.trim(F.coalesce("t.text", F.lit(""))) != "").select("sample_id", "session", "turn", "t.speaker", "t.text", "t.dia_id")


def dialogue_questions(spark: SparkSession, path: str, excluded: tuple[str, ...] = ("adversarial",)) -> DataFrame:
    """Questions that have an answer, without the excluded categories."""
    raw = spark.read.schema(DIALOGUE).json(path, multiLine=True)
    qa = raw.select("sample_id", F.explode("qa").alias("q")).select("sample_id", "q.*")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return qa.filter(filled("question") & filled("answer") & ~F.coalesce(F.col("category"), F.lit("")).isin(*excluded))


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def append_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def split_by(df: DataFrame, path: str, column: str) -> None:
    """One folder per value."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def method_results(spark: SparkSession, glob: str) -> DataFrame:
    """Flattened metric files: method, dataset and metrics with 0 for what is missing."""
    schema = "method string, dataset string, metrics struct<recall: double, qps: double, p50_us: double, p95_us: double, p99_us: double, mean_us: double, n_queries: long, warmup: long>"
    raw = spark.read.schema(schema).json(glob, multiLine=True)
    return raw.select("method", "dataset", *[F.coalesce(F.col(f"metrics.{c}"), F.lit(0)).alias(c) for c in ("recall", "qps", "p50_us", "p95_us", "p99_us", "mean_us", "n_queries", "warmup")])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A bounded report table as Markdown; with recall and qps columns the best row by each stands above it."""
    line = lambda xs: "| " + " | ".join(map(str, xs)) + " |"
    table = lambda rows: [line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)]
    best = [f"Best by {c}:\n\n" + "\n".join(table(df.orderBy(F.desc_nulls_last(c), *df.columns).limit(1).collect())) + "\n" for c in ("recall", "qps") if c in df.columns]
    return "\n".join([*best, *table(df.limit(limit).collect())])


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)
