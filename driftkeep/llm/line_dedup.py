"""Line dedup by site-relative frequency.

Within a host, a line's ratio is the share of the host's pages that contain
it. Lines over the boilerplate ratio are dropped from all pages of the host.

Only distinct (host, line hash) counts are shuffled, summed before and after
the exchange. The lines that exceed a ratio are few by arithmetic: their page
counts sum to at most the host's distinct page lines, so a host has no more of
them than mean distinct lines per page / ratio. They are written, counted, and
return to the pages as one array per host: broadcast if they are at most
BROADCAST_LINES, so that texts stay where they are, else by a join on host and
one of SALTS salts, so that the pages of a large host go to many tasks.

Defined results: lines are split at "\\n"; they are compared without blanks
at their ends. Blank lines are never counted nor dropped. A line must be
on at least ``min_pages`` pages, so a host of a few pages keeps its text. A
null text stays null, a null host is a host of its own. Repeated rows are pages
of their own unless ``once`` is set, which counts a host's equal texts (null as
empty) as one page; equal lines count once per page. A page whose lines all go
keeps its row with an empty text. All columns are kept; added ones take a free name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import bounded, free_name, numbered, stash
from driftkeep.llm.tables import table

RATIO, MIN_PAGES = 0.01, 10
BROADCAST_LINES, SALTS = 200_000, 64


def _key(line: F.Column) -> F.Column:
    return F.md5(F.trim(line).cast("binary"))


def _first_copies(docs: DataFrame, text: str, host: str) -> DataFrame:
    """The first row of a host's equal texts; the other rows are found by a digest of host and text."""
    rows = numbered(docs, "__page_row")
    page = F.md5(F.concat(F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary"))
    pages = stash(rows.select("__page_row", page.alias("__page")), "line-pages")
    copied = pages.groupBy("__page").agg(F.min("__page_row").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__page", "__first")
    again = stash(pages.join(bounded(stash(copied, "line-copied"), 250_000), "__page").filter("__page_row <> __first").select("__page_row"), "line-again")
    return rows.join(bounded(again), "__page_row", "left_anti").drop("__page_row")


def boilerplate(docs: DataFrame, text: str, host: str, ratio: float, min_pages: int, once: bool = False) -> DataFrame:
    """__host and __drop, the array of hashes of its boilerplate lines; with ``once`` the host's equal texts count as one page."""
    docs = docs.select(F.col(host).alias("h"), F.col(text).alias("t"))
    docs = _first_copies(docs, "t", "h") if once else docs
    totals = docs.groupBy(F.col("h").cast("string").alias("host")).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    lines = F.array_distinct(F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), _key))
    on = docs.select(F.col("h").cast("string").alias("host"), F.explode(lines).alias("line"))
    counts = on.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    found = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).filter(F.col("n") > ratio * F.col("pages"))
    return found.select(F.col("c.host").alias("__host"), "line").groupBy("__host").agg(F.collect_set("line").alias("__drop"))


def dedup_lines(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source", once: bool = False) -> DataFrame:
    """All columns, the text without its host's boilerplate, and ``n_lines``, ``n_dropped``."""
    h, drop, kept, salt = (free_name(n, docs) for n in ("__host", "__drop", "__kept", "__salt"))
    n_lines, n_dropped = free_name("n_lines", docs), free_name("n_dropped", docs)
    known = stash(boilerplate(docs, text, host, ratio, min_pages, once), "line-boilerplate").withColumnsRenamed({"__host": h, "__drop": drop})
    few = (known.agg(F.sum(F.size(drop) + 1)).first()[0] or 0) <= BROADCAST_LINES
    same = F.col(host).cast("string").eqNullSafe(F.col(h))
    if few:
        joined = docs.join(F.broadcast(known), same, "left").drop(h)
    else:
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)))
        spread = known.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = dealt.join(spread, same & (F.col(salt) == F.col("__s")), "left").drop(h, salt, "__s")
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _key(x)))
    hit = F.col(drop).isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(kept, F.when(hit, left))
    out = out.withColumn(n_lines, F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"))
    out = out.withColumn(n_dropped, F.when(hit, F.col(n_lines) - F.size(kept)).otherwise(0).cast("long"))
    return out.withColumn(text, F.when(F.col(n_dropped) > 0, F.array_join(kept, "\n")).otherwise(F.col(text))).drop(kept, drop)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def _sql(ratio: float, min_pages: int) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), boiler AS (
  SELECT l.source, trim(l.line) AS line FROM lines l JOIN pages p ON p.source = l.source WHERE trim(l.line) <> ''
  GROUP BY l.source, trim(l.line), p.n HAVING count(DISTINCT l.doc_id) > {ratio} * p.n AND count(DISTINCT l.doc_id) >= {min_pages}
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.line IS NULL) AS text
  FROM lines l LEFT JOIN boiler b ON b.source = l.source AND b.line = trim(l.line) GROUP BY l.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped FROM kept
"""


SQL = _sql(RATIO, MIN_PAGES)
