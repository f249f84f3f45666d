"""Relational operators over decision logs and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto(df: DataFrame, group: str | None = None, x: str = "recall", y: str = "qps") -> DataFrame:
    """Rows not beaten in y by any row of larger x; ties in y stay."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(1))).orderBy(F.desc(x), F.desc(y))
    best = F.max(y).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__best", best).filter(F.col("__best").isNull() | (F.col(y) >= F.col("__best"))).drop("__best")


def sliding(log: DataFrame, width: int, n: int) -> DataFrame:
    """start, acceptance, accepted, modal label (ties to the smaller), distinct labels of windows of ``width`` by half steps."""
    step = width // 2
    # A position lies in at most two windows.
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - width) / step).cast("long") + 1)
    each = log.withColumn("start", F.explode(F.sequence(first, F.floor(F.col("pos") / step).cast("long")))).withColumn("start", F.col("start") * step).filter((F.col("start") < n) & (F.col("pos") < F.col("start") + width))
    counts = each.groupBy("start", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("accepted").cast("long")).alias("a"))
    out = counts.groupBy("start").agg(F.sum("n").alias("items"), F.sum("a").alias("accepted"), F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("top"), F.count(F.lit(1)).alias("labels"))
    return out.select("start", (F.col("accepted") / F.col("items")).alias("acceptance"), "accepted", (-F.col("top.l")).cast("long").alias("modal_label"), "labels")


def running_size(log: DataFrame, every: int, n: int, key: str = "key") -> DataFrame:
    """Kept so far and its share at every ``every``-th position of each stream and at the last."""
    change = F.col("accepted").cast("long") - F.col("evicted").isNotNull().cast("long")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sized = log.withColumn("kept", F.sum(change).over(w))
    return sized.filter((F.col("pos") % every == 0) | (F.col("pos") == n - 1)).select(key, "pos", "kept", (F.col("kept") / (F.col("pos") + 1)).alias("share"))


def histogram(sig: DataFrame) -> DataFrame:
    """occupancy, buckets: how many buckets hold how many items."""
    each = sig.select(F.posexplode("sig").alias("t", "b")).groupBy("t", "b").agg(F.count(F.lit(1)).alias("occupancy"))
    return each.groupBy("occupancy").agg(F.count(F.lit(1)).alias("buckets"))


def snapshots(sig: DataFrame, at: list[int]) -> DataFrame:
    """The histogram over the items before each checkpoint."""
    upto = sig.withColumn("checkpoint", F.explode(F.array(*[F.lit(x).cast("long") for x in at]))).filter(F.col("pos") < F.col("checkpoint"))
    each = upto.select("checkpoint", F.posexplode("sig").alias("t", "b")).groupBy("checkpoint", "t", "b").agg(F.count(F.lit(1)).alias("occupancy"))
    return each.groupBy("checkpoint", "occupancy").agg(F.count(F.lit(1)).alias("buckets"))


def duplicate_discard(log: DataFrame) -> DataFrame:
    """Totals and acceptance of copies and originals, the discard rate of copies (null if none) and keep rate of originals."""
    dup = F.col("is_dup")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = log.agg(n(dup).alias("dup_total"), n(~dup).alias("orig_total"), n(dup & F.col("accepted")).alias("dup_accepted"), n(~dup & F.col("accepted")).alias("orig_accepted"))
    return out.select("*", (1 - F.col("dup_accepted") / F.when(F.col("dup_total") > 0, F.col("dup_total"))).alias("dup_discard_rate"), (F.col("orig_accepted") / F.greatest("orig_total", F.lit(1))).alias("orig_keep_rate"))


def macro_pivot(results: DataFrame, policies: list[str]) -> DataFrame:
    """Mean accuracy by budget, a column per policy; null accuracy is left out."""
    return results.filter(F.col("accuracy").isNotNull()).groupBy("budget").pivot("policy", policies).agg(F.avg("accuracy"))


def macro_micro(results: DataFrame) -> DataFrame:
    """policy, budget: mean of accuracies, and all correct over all asked."""
    return results.filter(F.col("accuracy").isNotNull()).groupBy("policy", "budget").agg(F.avg("accuracy").alias("macro"), (F.sum("correct") / F.sum("total")).alias("micro"), (F.stddev_samp("accuracy") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))


def remaining(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a grid without a result yet."""
    return grid.join(done, keys, "left_anti")


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """The rows whose value is named, under its new name."""
    return df.filter(F.col(column).isin(list(names))).replace(names, subset=[column])


def by_budget(df: DataFrame, budget: str, columns: list[str]) -> DataFrame:
    """Budgets in order with the mean of each column, 0 for columns that are missing or null."""
    value = lambda c: F.coalesce(F.avg(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.groupBy(budget).agg(*[value(c).alias(c) for c in columns]).orderBy(budget)


def scatter(df: DataFrame, method: str, value: str, x: str, y: str) -> DataFrame:
    """Two columns of one method's rows."""
    return df.filter(F.col(method) == value).select(x, y)


def histogram_bins(values: DataFrame, column: str, most: int = 50) -> DataFrame:
    """bin, start, stop, n over [0, p99 + 1] in at most ``most`` bins; empty bins have 0, values beyond lie in none, the last bin has its end."""
    top = values.agg(F.percentile(column, F.lit(0.99)).alias("p")).select((F.col("p") + 1).alias("top"), F.least(F.lit(most), F.floor(F.col("p") + 1)).cast("long").alias("bins")).filter("top is not null")
    inside = values.join(F.broadcast(top)).filter((F.col(column) >= 0) & (F.col(column) <= F.col("top")))
    n = inside.groupBy(F.least(F.floor(F.col(column) * F.col("bins") / F.col("top")), F.col("bins") - 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = top.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    width = F.col("top") / F.col("bins")
    return axis.join(n, "bin", "left").select("bin", (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("stop"), F.coalesce("n", F.lit(0)).alias("n"))


def midpoints(windows: DataFrame, width: int, n: int) -> DataFrame:
    """The windows with the middle of what they hold of a stream of ``n``."""
    return windows.withColumn("middle", (F.col("start") + F.least(F.col("start") + width, F.lit(n))) / 2)


def budget_grid(spark, n: int, policies: list[str], fractions: list[float], costly: dict[str, float], full_only: list[str]) -> DataFrame:
    """policy, fraction, capacity; costly policies up to their fraction only, the full budget for some policies only."""
    rows = [(p, f, max(int(n * f), 5)) for f in fractions for p in policies if f <= costly.get(p, 1.0) and (f < 1.0 or p in full_only)]
    return spark.createDataFrame(rows, "policy string, fraction double, capacity long")
