"""Sources, sinks, reports, question answering parts and the command line on small files."""

import json

import pytest
from pyspark.sql import functions as F

from driftkeep import __main__ as cli
from driftkeep.operators import qa, reports
from driftkeep.sources import readers


def test_dialogues(spark, tmp_path):
    turn = lambda s, t, i: {"speaker": s, "text": t, "dia_id": i}
    talk = {"speaker_a": "A", "speaker_b": "B", "session_10": [turn("A", "late", "D10:1")], "session_2": [turn("A", "hello", "D2:1"), turn("B", "  ", "D2:2"), turn("B", None, "D2:3"), turn("B", "bye", "D2:4")], "session_2_date": "x"}
    qs = [{"question": "q1", "answer": "a1", "category": "1", "evidence": ["D2:1"]}, {"question": "q2", "answer": "", "category": "1"}, {"question": "q3", "answer": "a", "category": "adversarial"}, {"question": None, "answer": "a"}]
    (tmp_path / "d.json").write_text(json.dumps([{"sample_id": "s", "conversation": talk, "qa": qs}]))
    turns = readers.dialogue_turns(spark, str(tmp_path / "d.json")).orderBy("session", "turn").collect()
    assert [(r.session, r.speaker, r.text) for r in turns] == [(2, "A", "hello"), (2, "B", "bye"), (10, "A", "late")]
    assert [r.question for r in readers.dialogue_questions(spark, str(tmp_path / "d.json")).collect()] == ["q1"]


def test_passages(spark):
    df = spark.createDataFrame([(0, [" a ", "", None, "b"]), (1, ["a", "c"]), (2, None)], "id long, passages array<string>")
    assert sorted(map(tuple, readers.passages(df).collect())) == [(0, "a"), (0, "b"), (1, "a"), (1, "c")]
    assert [tuple(r) for r in readers.passages(df, limit=3).collect()] == [(0, "a"), (0, "b"), (1, "a")]
    assert sorted(map(tuple, readers.passages(df, unique=True).collect())) == [(0, "a"), (0, "b"), (1, "c")]
    assert readers.sampled_passages(df, 3).count() == 4


def test_arrays_are_written_by_many_tasks(spark, tmp_path):
    import numpy as np

    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("pos"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = readers.write_npy(df, f"file://{tmp_path}/npy").orderBy("first_pos").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = np.concatenate([np.load(r.path.removeprefix("file://")) for r in files])
    assert len(files) > 1 and (whole[:, 0] == np.arange(1000)).all() and sum(r.n_rows for r in files) == 1000
    assert readers.npy_vectors(spark, f"{tmp_path}/npy/*.npy").agg(F.count("v"), F.sum(F.col("v")[0])).first() == (1000, 499_500.0)


def test_results_and_reports(spark, tmp_path):
    for i, recall in enumerate((0.5, 0.9)):
        (tmp_path / f"m{i}.json").write_text(json.dumps({"method": f"m{i}", "dataset": "d", "metrics": {"recall": recall, "qps": 10.0 - i}}))
    found = readers.method_results(spark, f"{tmp_path}/*.json")
    assert sorted((r.method, r.recall, r.p50_us) for r in found.collect()) == [("m0", 0.5, 0.0), ("m1", 0.9, 0.0)]
    text = cli.main(["summarize", "--results", f"{tmp_path}/*.json"], spark)
    assert text.startswith("Best by recall:") and text.index("| m1 |") < text.index("Best by qps:") < text.index("| m0 |")
    readers.append_csv(found, f"{tmp_path}/csv", "overwrite")
    readers.append_csv(found, f"{tmp_path}/csv")
    assert readers.results_csv(spark, f"{tmp_path}/csv", spark.createDataFrame([], found.schema).schema).count() == 4
    readers.write_json(found, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert [tuple(r) for r in reports.renamed(found, "method", {"m1": "second"}).select("method", "recall").collect()] == [("second", 0.9)]
    assert [tuple(r) for r in reports.by_budget(found, "n_queries", ["recall", "absent"]).collect()] == [(0, pytest.approx(0.7), 0.0)]
    bins = reports.histogram_bins(spark.createDataFrame([(float(x),) for x in (0, 0, 1, 3, 3, 3)], "x double"), "x").orderBy("bin").collect()
    assert sum(r.n for r in bins) == 6 and bins[0].start == 0.0 and bins[-1].stop == pytest.approx(4.0) and len(bins) == 4
    assert reports.histogram_bins(spark.createDataFrame([], "x double"), "x").count() == 0


def test_a_server_can_answer_and_judge(spark):
    turns = spark.createDataFrame([(1, 1, "user", "where is it"), (1, 2, "assistant", "in the box"), (1, 3, "user", "alone")], "conv_id long, pos long, role string, text string")
    assert [tuple(r) for r in qa.questions(turns).collect()] == [(1, 1, "where is it", "in the box")]
    v = readers.embed(turns, dim=8)
    asked = qa.questions(turns).join(v.select("conv_id", F.col("pos").alias("query_id"), F.col("v").alias("q")), ["conv_id", "query_id"])
    memory = v.select("conv_id", F.col("pos").alias("item_id"), "v", F.col("text").alias("line"))
    kept = qa.kept_turns(turns, (0.5, 1.0), least=1)
    assert kept.filter("fraction = 0.5").count() == 2 and kept.filter("fraction = 1.0 and policy = 'FIFO'").count() == 3
    plain = {(r.policy, r.fraction): r.score for r in qa.answered(asked, memory, kept).collect()}
    assert plain["FIFO", 1.0] == 1.0 and plain["FIFO", 0.5] == 0.0
    other = qa.answered(asked, memory, kept, answer=lambda c: F.lit("?"), judge=lambda p, a: F.length(p).cast("double"))
    assert {r.score for r in other.collect()} == {1.0}


def test_command_line(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    assert "fifo_kept" in cli.main(["list"]).split("\n")
    out = f"{tmp_path}/o"
    cli.main(["run", "fifo_kept", "--data", data, "--output", out, "--format", "csv"], spark)
    assert spark.read.csv(out, header=True).count() == 250
    cli.main(["ground-truth", "--base", f"{data}/embeddings.parquet", "--query", f"{data}/embeddings.parquet", "--output", out, "--k", "2"], spark)
    assert spark.read.parquet(out).filter("rank = 1 and query_id = item_id").count() == 500
    for policy in ("fifo", "bucket_occupancy", "semantic_dedup"):
        cli.main(["keep", "--policy", policy, "--capacity", "20", "--base", f"{data}/embeddings.parquet", "--output", out], spark)
        assert spark.read.parquet(out).count() == 20
