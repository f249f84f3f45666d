"""Intermediate tables in the folder that the cluster shares, so that what was decided once stays decided."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="driftkeep-"))
    return (named or _own[0]).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/driftkeep-streams/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> None:
    """Delete all staged tables; for when every result has been written or read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/driftkeep-streams")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
