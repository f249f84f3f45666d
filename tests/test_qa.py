"""Question answering: contexts of every policy and budget without a text beside each pair of a question and a turn."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkeep.operators import qa, scans


@pytest.fixture
def talks(spark):
    """Conversations of 1 to 90 turns with coarse vectors, so that many scores tie; names are texts."""
    rng = np.random.default_rng(3)
    return {f"c{i}": rng.integers(0, 3, (n, 4)).astype(float) for i, n in enumerate([1, 2, 90, 5, 14, 70, 3])}


def asked_and_kept(spark, talks):
    memory = spark.createDataFrame([(c, i + 1, v.tolist(), f"{c} says {i}") for c, vs in talks.items() for i, v in enumerate(vs)], "conv_id string, item_id long, v array<double>, line string")
    asked = memory.filter("item_id % 3 = 1 and conv_id <> 'c3'").select("conv_id", F.col("item_id").alias("query_id"), F.col("v").alias("q"), F.lit("says 1").alias("answer"))
    kept = qa.kept_turns(memory.select("conv_id", F.col("item_id").alias("pos")))
    return asked, memory, kept


@pytest.mark.parametrize("batch, scores", [("10000", 2_000_000), ("7", 100)])
def test_contexts(spark, talks, monkeypatch, batch, scores):
    monkeypatch.setattr(scans, "SCORES", scores)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        asked, memory, kept = asked_and_kept(spark, talks)
        shown = lambda context, answer: F.concat_ws("|", context, answer)
        got = {(r.policy, r.fraction, r.conv_id, r.query_id): r.score for r in qa.answered(asked, memory, kept, 5, judge=shown).collect()}
        held = {}
        for r in kept.collect():
            held.setdefault((r.policy, r.fraction, r.conv_id), []).append(r.item_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for (policy, fraction, c), items in held.items():
        for i in [] if c == "c3" else range(0, len(talks[c]), 3):
            near = sorted(items, key=lambda j: (-(talks[c][i] @ talks[c][j - 1]), j))[:5]
            want[policy, fraction, c, i + 1] = "\n".join(f"{c} says {j - 1}" for j in near) + "|says 1"
    assert got == want


def test_pairs_are_not_rows(spark, talks):
    """A text went with every pair of a question and a turn, once for each budget, through a window."""
    plan = qa.answered(*asked_and_kept(spark, talks))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[row_number.*fraction", plan) and plan.count("collect_list") == 2
