"""Queries over conversations, result tables and streaming runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftkeep.functions.vectors import rounded
from driftkeep.operators import knn, metrics, policies, qa, reports
from driftkeep.plans.fragments import BASE, BITS, DIM, TABLES, h, with_
from driftkeep.plans.search import base, signed
from driftkeep.sources.readers import embed
from driftkeep.sources.staging import new_folder, staged
from driftkeep.streaming import policies as streaming


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, pos, role, text: turns in order, blank ones dropped."""
    raw = spark.read.parquet(f"{d}/conversations.parquet").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return raw.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("pos"), "turn", "role", "text")


TURNS = "tn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn, role, text FROM conversations WHERE trim(coalesce(text, '')) <> '')"


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "pos", "role", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))


TURNS_SQL = with_(TURNS, select="SELECT conv_id, pos, role, role || ': ' || text AS line FROM tn")


def conversation_kept(spark: SparkSession, d: str) -> DataFrame:
    """The last quarter of each conversation, five turns at least."""
    t = turns(spark, d)
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    sized = t.withColumn("b", F.greatest(F.floor(n * 0.25), F.lit(5))).withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("pos"))))
    return sized.filter(F.col("back") <= F.col("b")).select("conv_id", "pos", "turn")


CKEPT_SQL = with_(TURNS, select="SELECT conv_id, pos, turn FROM tn QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= greatest(floor(count(*) OVER (PARTITION BY conv_id) * 0.25), 5)")


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The five kept turns nearest to each conversation's first user turn, by hashed words."""
    v = embed(turns(spark, d), dim=16)
    kept = conversation_kept(spark, d).select("conv_id", "pos")
    items = v.join(kept, ["conv_id", "pos"]).select("conv_id", F.col("pos").alias("item_id"), "v", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    first = v.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("v", "pos").alias("q")).withColumn("query_id", F.col("conv_id"))
    near = knn.within_groups(first, items.select("conv_id", "item_id", "v"), 5, "conv_id")
    return near.select("conv_id", "item_id", rounded(F.col("score")).alias("score"))


def _retrieved(top: bool = True) -> str:
    parts = [
        TURNS,
        "wd AS (SELECT conv_id, pos, role, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM tn)",
        "sl AS (SELECT conv_id, pos, role, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS k, count(*)::DOUBLE AS n FROM wd GROUP BY ALL)",
        "nm AS (SELECT conv_id, pos, role, k, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, pos)) AS x FROM sl)",
        f"kp AS ({CKEPT_SQL.split(TURNS, 1)[1].strip()})",
        "fu AS (SELECT conv_id, min(pos) AS pos FROM tn WHERE role = 'user' GROUP BY conv_id)",
        "sc AS (SELECT a.conv_id, b.pos AS item_id, sum(a.x * b.x) AS s FROM nm a JOIN fu ON fu.conv_id = a.conv_id AND fu.pos = a.pos JOIN nm b ON b.conv_id = a.conv_id AND b.k = a.k JOIN kp ON kp.conv_id = b.conv_id AND kp.pos = b.pos GROUP BY ALL)",
        "al AS (SELECT kp.conv_id, kp.pos AS item_id, round(coalesce(s, 0), 6) AS score, coalesce(s, 0) AS s FROM kp JOIN fu USING (conv_id) LEFT JOIN sc ON sc.conv_id = kp.conv_id AND sc.item_id = kp.pos)",
    ]
    return with_(*parts, select="SELECT conv_id, item_id, score FROM al QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(s, 9) DESC, item_id) <= 5")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn scored against the turn before it: does either text hold the other's first word?"""
    w = Window.partitionBy("conv_id").orderBy("pos")
    t = turns(spark, d).withColumn("asked", F.lag("text").over(w)).filter("role = 'assistant'")
    return t.select("conv_id", "pos", metrics.answer_score(F.col("text"), F.element_at(F.split(F.coalesce("asked", F.lit("?")), " "), 1)).alias("score"))


_ANSWERS = "an AS (SELECT conv_id, pos, CASE WHEN length(p) > 0 AND (contains(p, a) OR contains(a, p)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT conv_id, pos, role, lower(trim(text)) AS p, lower(trim(string_split(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY pos), '?'), ' ')[1])) AS a FROM tn) WHERE role = 'assistant')"
ANSWERS_SQL = with_(TURNS, _ANSWERS, select="SELECT conv_id, pos, score FROM an")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    t = staged(embed(turns(spark, d), dim=16), "turns")
    asked = qa.questions(t, "v").withColumnRenamed("v", "q")
    memory = t.select("conv_id", F.col("pos").alias("item_id"), "v", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    return qa.answered(asked, memory, qa.kept_turns(t))


def qa_answers(spark: SparkSession, d: str) -> DataFrame:
    """Score of every question under every policy and budget."""
    return _answers(spark, d)


def qa_results(spark: SparkSession, d: str) -> DataFrame:
    """A row for each conversation, policy and budget."""
    return _round(qa.accuracy(_answers(spark, d)))


_QA = [
    TURNS,
    "wd AS (SELECT conv_id, pos, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM tn)",
    "sl AS (SELECT conv_id, pos, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS k, count(*)::DOUBLE AS n FROM wd GROUP BY ALL)",
    "nm AS (SELECT conv_id, pos, k, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, pos)) AS x FROM sl)",
    "qs AS (SELECT conv_id, pos AS qid, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM tn WINDOW w AS (PARTITION BY conv_id ORDER BY pos)) WHERE role = 'user' AND nr = 'assistant')",
    f"rk AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS fr, row_number() OVER (PARTITION BY conv_id ORDER BY {h("(conv_id || ':' || pos)", 42)}, pos) AS rr FROM tn)",
    f"kq AS (SELECT policy, fraction, conv_id, pos FROM rk, (SELECT unnest(['FIFO', 'Reservoir']) AS policy), (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 1.0]) AS fraction) WHERE CASE policy WHEN 'FIFO' THEN fr ELSE rr END <= greatest(floor(n * fraction), {qa.LEAST}))",
    "ds AS (SELECT a.conv_id, a.pos AS qid, b.pos, sum(a.x * b.x) AS s FROM nm a JOIN nm b ON a.conv_id = b.conv_id AND a.k = b.k GROUP BY ALL)",
    "sq AS (SELECT qs.conv_id, qs.qid, tn.pos, role || ': ' || text AS line, round(coalesce(s, 0), 9) AS s FROM qs JOIN tn USING (conv_id) LEFT JOIN ds ON ds.conv_id = qs.conv_id AND ds.qid = qs.qid AND ds.pos = tn.pos)",
    f"nr AS (SELECT policy, fraction, conv_id, qid, line, row_number() OVER (PARTITION BY policy, fraction, conv_id, qid ORDER BY s DESC, pos) AS rank FROM sq JOIN kq USING (conv_id, pos) QUALIFY rank <= {qa.CONTEXT})",
    "cx AS (SELECT policy, fraction, conv_id, qid, lower(trim(string_agg(line, chr(10) ORDER BY rank))) AS p FROM nr GROUP BY ALL)",
    "an AS (SELECT policy, fraction, conv_id, qid AS query_id, CASE WHEN length(p) > 0 AND (contains(p, lower(trim(answer))) OR contains(lower(trim(answer)), p)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM cx JOIN qs USING (conv_id, qid))",
]
_RESULTS = "re AS (SELECT policy, fraction AS budget, conv_id, sum(score)::BIGINT AS correct, count(*) AS total, sum(score) / count(*) AS accuracy FROM an GROUP BY ALL)"
QA_ANSWERS_SQL = with_(*_QA, select="SELECT * FROM an")
QA_RESULTS_SQL = with_(*_QA, _RESULTS, select="SELECT policy, budget, conv_id, correct, total, round(accuracy, 6) AS accuracy FROM re")


def _round(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def qa_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.macro_micro(qa.accuracy(_answers(spark, d))))


QA_SQL = with_(*_QA, _RESULTS, select="SELECT policy, budget, round(avg(accuracy), 6) AS macro, round(sum(correct) / sum(total)::DOUBLE, 6) AS micro, round(stddev_samp(accuracy) / sqrt(count(*)), 6) AS standard_error FROM re GROUP BY ALL")


def budget_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.macro_pivot(qa.accuracy(_answers(spark, d)), ["FIFO", "Reservoir"]))


PIVOT_SQL = with_(*_QA, _RESULTS, select="SELECT budget, round(avg(accuracy) FILTER (WHERE policy = 'FIFO'), 6) AS \"FIFO\", round(avg(accuracy) FILTER (WHERE policy = 'Reservoir'), 6) AS \"Reservoir\" FROM re GROUP BY budget")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """A table of methods with recall and qps, from parts: fixed numbers at every size."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("config"), (F.col("p_partkey") % 4).alias("method"), ((F.col("p_partkey") * 37) % 101 / 100.0).alias("recall"), ((F.col("p_partkey") * 91) % 997).cast("double").alias("qps"))


_POINTS = "pt AS (SELECT p_partkey AS config, p_partkey % 4 AS method, (p_partkey * 37) % 101 / 100.0::DOUBLE AS recall, ((p_partkey * 91) % 997)::DOUBLE AS qps FROM part)"


def pareto(spark: SparkSession, d: str) -> DataFrame:
    return reports.pareto(_points(spark, d).withColumn("qps", F.col("qps") + F.col("config") / 1e6), "method").select("method", "config", rounded(F.col("recall")).alias("recall"), rounded(F.col("qps")).alias("qps"))


PARETO_SQL = with_(_POINTS, "p2 AS (SELECT config, method, recall, qps + config / 1e6::DOUBLE AS qps FROM pt)", "m AS (SELECT *, max(qps) OVER (PARTITION BY method ORDER BY recall DESC, qps DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p2)", select="SELECT method, config, round(recall, 6) AS recall, round(qps, 6) AS qps FROM m WHERE b IS NULL OR qps >= b")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    toxic, high = F.col("toxic") == 1, F.col("quality") == 0
    c = spark.read.parquet(f"{d}/labels.parquet").agg(n(toxic & high).alias("tp"), n(~toxic & high).alias("fp"), n(toxic & ~high).alias("fn"), n(~toxic & ~high).alias("tn"), n(high).alias("filter_stored"), F.count(F.lit(1)).alias("n_stream"))
    return _round(c.select("tp", "fp", "fn", "tn", *metrics.confusion_rates()))


CONFUSION_SQL = "WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (WHERE toxic <> 1 AND quality <> 0) AS tn, count(*) FILTER (WHERE quality = 0) AS st, count(*) AS n FROM labels) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(st / n::DOUBLE, 6) AS compression, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_admit_rate, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS false_reject_rate FROM c"


def budget_grid(spark: SparkSession, d: str) -> DataFrame:
    n = base(spark, d).count()
    return reports.budget_grid(spark, n, ["BucketOccupancy", "FIFO", "Reservoir", "SemanticDedup"], [0.01, 0.05, 0.1, 0.25, 0.5, 1.0], {"SemanticDedup": 0.05}, ["BucketOccupancy", "FIFO"])


def resume(spark: SparkSession, d: str) -> DataFrame:
    return reports.remaining(budget_grid(spark, d), budget_grid(spark, d).filter("fraction < 0.1 and policy <> 'FIFO'"), ["policy", "fraction"])


_GRID = "gr AS (SELECT policy, fraction, greatest(floor(n * fraction), 5)::BIGINT AS capacity FROM (SELECT count(*) AS n FROM e), (SELECT unnest(['BucketOccupancy', 'FIFO', 'Reservoir', 'SemanticDedup']) AS policy), (SELECT unnest([0.01::DOUBLE, 0.05, 0.1, 0.25, 0.5, 1.0]) AS fraction) WHERE (policy <> 'SemanticDedup' OR fraction <= 0.05) AND (fraction < 1 OR policy IN ('BucketOccupancy', 'FIFO')))"
GRID_SQL = with_(BASE, _GRID, select="SELECT * FROM gr")
RESUME_SQL = with_(BASE, _GRID, select="SELECT * FROM gr WHERE NOT (fraction < 0.1 AND policy <> 'FIFO')")


def latency(spark: SparkSession, d: str) -> DataFrame:
    return _round(metrics.latency(spark.read.parquet(f"{d}/events.parquet").select((F.col("value") * 1000).alias("ns")), "ns"))


LATENCY_SQL = "WITH l AS (SELECT value * 1000 / 1000.0 AS u FROM events), p AS (SELECT avg(u) AS mean_us, quantile_cont(u, 0.5) AS p50_us, quantile_cont(u, 0.95) AS p95_us, quantile_cont(u, 0.99) AS p99_us, quantile_cont(u, 0.999) AS p999_us, max(u) AS max_us FROM l) SELECT round(mean_us, 6) AS mean_us, round(p50_us, 6) AS p50_us, round(p95_us, 6) AS p95_us, round(p99_us, 6) AS p99_us, round(p999_us, 6) AS p999_us, round(max_us, 6) AS max_us, round(p99_us / nullif(p50_us, 0), 6) AS tail_ratio FROM p"


def time_shares(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds and percent of the total by event type."""
    g = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.sum("value").alias("s"))
    all_ = g.agg(F.sum("s").alias("all"))
    return g.join(F.broadcast(all_)).select("event_type", rounded(F.col("s") * 1e6, 2).alias("us"), rounded(F.col("s") / F.col("all") * 100, 4).alias("percent"))


SHARES_SQL = "SELECT event_type, round(sum(value) * 1e6, 2) AS us, round(sum(value) / (SELECT sum(value) FROM events) * 100, 4) AS percent FROM events GROUP BY event_type"


def bernoulli_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """A thinned wide table, counted by flag."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), "l_returnflag")
    return policies.bernoulli(li, 1, 10).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


LINEITEM_SQL = f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {h('(l_orderkey * 8 + l_linenumber)', 42)} / 4294967296.0::DOUBLE < 0.1::DOUBLE GROUP BY l_returnflag"


def user_fifo(spark: SparkSession, d: str) -> DataFrame:
    """The five most recent events of each user."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("pos"))
    return policies.fifo(e, 5, key="user_id")


USER_SQL = "SELECT user_id, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5"


def _streamed(df: DataFrame, make, name: str) -> DataFrame:
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    return streaming.run_to_end(make(source), folder)


def streaming_fifo(spark: SparkSession, d: str) -> DataFrame:
    keyed = signed(spark, d).select(F.col("label").alias("key"), "pos", "item_id")
    return policies.kept(_streamed(keyed, lambda s: streaming.fifo(s, 10), "fifo"))


def streaming_bucket_occupancy(spark: SparkSession, d: str) -> DataFrame:
    keyed = signed(spark, d).select(F.col("label").alias("key"), "pos", "item_id", "sig")
    return _streamed(keyed, lambda s: streaming.bucket_occupancy(s, 10), "occupancy").select("key", "pos", "item_id", "accepted", rounded(F.col("occ")).alias("occ"), "evicted")


STREAM_FIFO_SQL = "SELECT label::BIGINT AS key, row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id AS item_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 10"


def _same_as_batch() -> str:
    from driftkeep.plans.retention import ENTRIES

    return ENTRIES["bucket_occupancy_capacity"][1]


ENTRIES = {
    "conversation_turns": (conversation_turns, TURNS_SQL), "conversation_kept": (conversation_kept, CKEPT_SQL), "conversation_retrieve": (retrieve, _retrieved()), "answer_score": (answers, ANSWERS_SQL), "qa_answers": (qa_answers, QA_ANSWERS_SQL), "qa_results": (qa_results, QA_RESULTS_SQL), "qa_accuracy_macro_micro": (qa_accuracy, QA_SQL), "budget_pivot": (budget_pivot, PIVOT_SQL),
    "pareto_frontier": (pareto, PARETO_SQL), "confusion_rates": (confusion, CONFUSION_SQL), "budget_grid": (budget_grid, GRID_SQL), "resume_antijoin": (resume, RESUME_SQL), "latency_percentiles": (latency, LATENCY_SQL), "time_shares": (time_shares, SHARES_SQL),
    "bernoulli_lineitem": (bernoulli_lineitem, LINEITEM_SQL), "user_fifo": (user_fifo, USER_SQL), "streaming_fifo": (streaming_fifo, STREAM_FIFO_SQL), "streaming_bucket_occupancy": (streaming_bucket_occupancy, _same_as_batch()),
}
