"""Where intermediate tables go, so that a lost executor costs a task and not the job."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkeep.operators.streams import positions

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="driftkeep-"))
        base = _local[0]
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/driftkeep/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, each row is computed once."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stashed tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stashed_at", None)
        if path:
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of the shared folder; for when every result has been written or read."""
    _delete(spark, f"{shared_dir(spark)}/driftkeep")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@lru_cache(1)
def _trim():
    """glibc's malloc_trim; nothing to call where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run):
    """The mapper, after whose last batch the worker hands freed memory back.

    Workers stay for the stages that follow, and allocators keep what a stage
    has freed: an executor would hold the largest need of every stage at once.
    """

    def mapper(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return mapper


def map_pandas(df: DataFrame, run, schema: str, ids: tuple[str, ...]) -> DataFrame:
    """mapInPandas with the columns ``ids`` as text on the way, in and out: pandas would round longs above 2**53 that stand beside nulls."""
    kinds = T.StructType.fromDDL(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType() if f.name in ids else f.dataType) for f in kinds.fields])
    given = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    out = given.mapInPandas(lean(run), texts)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A narrow table marked for broadcast if it is counted to have at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, lengthened by underscores until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """The rows with a number each that stays the same however often, with whichever columns and in whichever splits they are read.

    A plain scan of files numbers a row by its file and its place in it;
    anything else (a shuffle before, rows made on the driver) is written to the
    shared folder first.
    """
    df = scanned(df)
    path, file, place, at = (free_name(n, df) for n in ("__path", "__file", "__place", "__at"))
    hashed = F.xxhash64("_metadata.file_path")
    files = positions(df.select(F.col("_metadata.file_path").alias(path)).distinct().withColumn(file, F.xxhash64(path)), F.col(path)).select(file, F.col("pos").alias(at))
    n, different = files.agg(F.count(file), F.countDistinct(file)).first()
    if n != different:
        raise ValueError("two files of one hash")
    rows = df.withColumns({file: hashed, place: F.col("_metadata.row_index")})
    return rows.join(bounded(files, 2_000_000), file).withColumn(name, F.shiftleft(at, 36).bitwiseOR(F.col(place))).select(*df.columns, name)


def scanned(df: DataFrame) -> DataFrame:
    """The table as files: itself if it is a plain scan of some, else written to the shared folder."""
    return df if _is_scan(df) else stash(df, "rows")


def _is_scan(df: DataFrame) -> bool:
    """Whether only projections and filters lie over one relation of files, whose rows have a file and a place."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", x) for x in plan if x.strip()) and bool(df.inputFiles()) and "parquet" in plan[-1]
