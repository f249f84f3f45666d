"""K-d tree partitioning of a corpus into shards of near-equal bytes.

Space is cut recursively: each open node is split along its widest metadata
dimension at a weighted quantile, until a leaf holds the target bytes. All
open nodes of a level are split at once; the quantile is found by radix
descent over integer coordinates, with one small partial aggregation per
digit, so no row is sorted, collected or sent to one task. Nodes, quantiles and
cuts are tables beside the rows, broadcast if there are at most BROADCAST_NODES
shards, so neither plan nor driver grows with the shards; rows of finished leaves are
not read again.

A text dimension is measured by the rank of its whole value among the distinct
ones. Defined results: a null text has 0 bytes (size = overhead) and the crc32
of the empty string. Null metadata sorts first in its dimension. Ties on a
coordinate are broken by the text's crc32, so copies stay together where a
boundary permits, then by a row number, so that a group of equal texts of any
size can be cut and repeated rows are kept one by one. An empty table gives an
empty result. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkeep.llm.shared import bounded, fresh_dir, stash
from driftkeep.llm.tables import table
from driftkeep.operators.streams import positions

#: Bits of a coordinate: of its dimension, of the text's crc32, of the row number's hash.
DIM_BITS, CRC_BITS, ROW_BITS = 20, 32, 10
KEY_BITS = DIM_BITS + CRC_BITS + ROW_BITS
#: Bits that one pass of the descent fixes.
DIGIT_BITS = 16
OVERHEAD = 16
BROADCAST_NODES = 250_000


def metadata(docs: DataFrame, dims: list[str]) -> DataFrame:
    """One narrow row per document: id, size, crc32, row number and the dimensions as numbers, text as ranks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    is_text = lambda d: d != "bytes" and isinstance(docs.schema[d].dataType, T.StringType)
    raw = lambda d: F.octet_length(text).cast("double") if d == "bytes" else F.col(d) if is_text(d) else F.col(d).cast("double")
    meta = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("__row"), *[raw(d).alias(f"__raw{i}") for i, d in enumerate(dims)])
    meta = stash(meta, "kd-meta")
    for i, d in enumerate(dims):
        if is_text(d):
            name = f"__raw{i}"
            ranks = positions(meta.select(name).filter(F.col(name).isNotNull()).distinct(), F.col(name)).select(F.col(name).alias("__value"), (F.col("pos") + 1).cast("double").alias("__rank"))
            meta = meta.join(bounded(ranks, 100_000), F.col(name) == F.col("__value"), "left").withColumn(name, F.coalesce("__rank", F.lit(0.0))).drop("__value", "__rank")
    return meta


def coordinates(meta: DataFrame, n_dims: int) -> DataFrame:
    """Every dimension scaled to DIM_BITS and joined with the tie-breakers into one long."""
    lows = meta.agg(*[f(F.when(~F.isnan(f"__raw{i}"), F.col(f"__raw{i}"))).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tie = F.shiftleft(F.col("text_crc32"), ROW_BITS).bitwiseOR(F.pmod(F.xxhash64("__row"), F.lit(1 << ROW_BITS)))
    out = meta.select("doc_id", "size", "text_crc32", "__row", *[f"__raw{i}" for i in range(n_dims)])
    for i in range(n_dims):
        lo, hi = lows[f"lo{i}"], lows[f"hi{i}"]
        unit = F.lit(0.0) if lo is None or hi <= lo else (F.col(f"__raw{i}") - F.lit(lo)) / F.lit(hi - lo)
        grid = F.floor(F.coalesce(F.nanvl(unit, F.lit(0.0)), F.lit(0.0)) * ((1 << DIM_BITS) - 1)).cast("long")
        out = out.withColumn(f"__k{i}", F.shiftleft(grid, CRC_BITS + ROW_BITS).bitwiseOR(tie))
    return out.drop(*[f"__raw{i}" for i in range(n_dims)])


def open_nodes(df: DataFrame, n_dims: int) -> DataFrame:
    """Nodes of more than one shard: __node, dim (the widest, the first of equals) and want, the bytes for the left part's shards."""
    span = lambda i: F.max(F.shiftright(f"__k{i}", CRC_BITS + ROW_BITS)) - F.min(F.shiftright(f"__k{i}", CRC_BITS + ROW_BITS))
    nodes = df.groupBy("__node", "__shards").agg(F.sum("size").alias("weight"), F.array(*[span(i) for i in range(n_dims)]).alias("spans"))
    half, n = F.floor(F.col("__shards") / 2).cast("long"), F.col("__shards").cast("long")
    each = F.floor(F.col("weight") / n).cast("long")
    want = each * half + F.floor((F.col("weight") - each * n) * half / n).cast("long")
    return nodes.select("__node", (F.array_position("spans", F.array_max("spans")) - 1).cast("int").alias("dim"), want.alias("want"))


def _key(n_dims: int):
    return F.element_at(F.array(*[F.col(f"__k{i}") for i in range(n_dims)]), F.col("dim") + 1)


def cuts(df: DataFrame, nodes: DataFrame, n_dims: int, slack: int, near) -> DataFrame:
    """__node, dim, cut: keys under the cut go left. A descent fixes DIGIT_BITS of every node's quantile at a time.

    A node is done when the bin that its quantile lies in has at most ``slack`` bytes: the whole bin goes to the side that leaves the smaller error.
    """
    keyed = df.select("__node", "size", *[f"__k{i}" for i in range(n_dims)])
    state = nodes.select("__node", "dim", "want", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    known, done = 0, None
    while known < KEY_BITS:
        step = min(DIGIT_BITS, KEY_BITS - known)
        shift = KEY_BITS - known - step
        part = keyed.join(near(state), "__node").withColumn("__key", _key(n_dims))
        if known:
            part = part.filter(F.shiftright("__key", KEY_BITS - known) == F.col("prefix"))
        bins = part.groupBy("__node", "dim", "want", "below", F.shiftright("__key", shift).alias("bin")).agg(F.sum("size").alias("w"))
        # At most 2**DIGIT_BITS bins of a node meet in a window.
        upto = F.sum("w").over(Window.partitionBy("__node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        at = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("want")).groupBy("__node", "dim", "want").agg(F.min(F.struct("bin", "upto", "w")).alias("x")).select("__node", "dim", "want", "x.*")
        after = (F.col("upto") - F.col("want") < F.col("want") - (F.col("upto") - F.col("w"))).cast("long")
        found = stash(at.select("__node", "dim", "want", F.col("bin").alias("prefix"), (F.col("upto") - F.col("w")).alias("below"), ((F.col("w") <= slack) | F.lit(shift == 0)).alias("fixed"), F.shiftleft(F.col("bin") + after, shift).alias("cut")), "kd-quantiles")
        now = found.filter("fixed").select("__node", "dim", "cut")
        done = now if done is None else done.unionByName(now)
        state = found.filter("not fixed").drop("fixed", "cut")
        known += step
        if state.isEmpty():
            break
    return done


def split_level(df: DataFrame, n_dims: int, slack: int, near) -> DataFrame:
    """The rows of open nodes in their halves, as a table that is filed by whether a row's node is a leaf now; ``near`` marks tables of nodes for their joins."""
    cut = cuts(df, open_nodes(df, n_dims), n_dims, slack, near)
    left, half = F.col("__key") < F.col("cut"), F.floor(F.col("__shards") / 2).cast("int")
    moved = df.join(near(cut), "__node").withColumn("__key", _key(n_dims))
    moved = moved.select(
        "doc_id", "size", "text_crc32", "__row", *[f"__k{i}" for i in range(n_dims)],
        F.when(left, 2 * F.col("__node")).otherwise(2 * F.col("__node") + 1).alias("__node"),
        F.when(left, F.col("__first")).otherwise(F.col("__first") + half).alias("__first"),
        F.when(left, half).otherwise(F.col("__shards") - half).alias("__shards"),
    )
    path = fresh_dir(df.sparkSession, "kd-level")
    moved.withColumn("__leaf", (F.col("__shards") == 1).cast("int")).write.partitionBy("__leaf").parquet(path)
    return df.sparkSession.read.schema(T.StructType([*moved.schema.fields, T.StructField("__leaf", T.IntegerType())])).parquet(path)


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("bytes", "n_chars", "lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    Give ``n_shards``, or ``target_bytes`` for as many leaves as that takes.
    ``slot`` numbers the rows of a shard from 0 without gaps.
    """
    dims = [d for d in dims if d == "bytes" or d in docs.columns] or ["bytes"]
    meta = metadata(docs, dims)
    total = meta.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // max(1, target_bytes or 1)))
    rows = stash(coordinates(meta, len(dims)).withColumns({"__node": F.lit(1).cast("long"), "__first": F.lit(0), "__shards": F.lit(n_shards)}), "kd-level")
    leaves, open_ = rows.filter("__shards = 1"), rows.filter("__shards > 1")
    # No level has more nodes than there are shards, so their number says whether tables of nodes are broadcast.
    near = F.broadcast if n_shards <= BROADCAST_NODES else lambda x: x
    for _ in range((n_shards - 1).bit_length()):
        level = split_level(open_, len(dims), max(1, total // n_shards // 2000), near)
        leaves, open_ = leaves.unionByName(level.filter("__leaf = 1").drop("__leaf")), level.filter("__leaf = 0").drop("__leaf")
    placed = stash(leaves.select("doc_id", "size", "text_crc32", "__row", F.col("__first").alias("shard")), "kd-placed")
    # Slots in two steps, so that no shard has to pass through one task: rows of a
    # read block are numbered where they are, blocks start after those before them.
    block = F.shiftright("__row", 33)
    fine = F.struct(block.alias("b"), F.shiftright(F.col("__row").bitwiseAND((1 << 33) - 1), 12).alias("c"))
    counts = placed.groupBy("shard", fine.alias("blk")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("blk")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "blk").orderBy("__row")) - 1
    return (
        placed.withColumn("blk", fine)
        .withColumn("within", within)
        .join(starts, ["shard", "blk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, placement: DataFrame, path: str) -> None:
    """The shards as files, one folder each; ``doc_id`` must be unique here."""
    docs.join(placement.select("doc_id", "shard", "slot"), "doc_id").repartition("shard", F.shiftright("slot", 16)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), n_shards=40)
