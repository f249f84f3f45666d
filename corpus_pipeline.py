"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftkeep.llm import bpe, decontaminate, line_dedup, minhash_dedup, toxicity
from driftkeep.llm.shared import stash
from driftkeep.llm.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this corpus's labels, scores under 0.5."""
    lexicon, model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, model)
    return scored.filter(scored[scored.columns[-1]] < 0.5).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; copies of a text count once, so that they don't make its lines boilerplate."""
    return line_dedup.dedup_lines(docs, once=True).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash_dedup.keep_first(docs, width=5, percent=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", to_tokens),
]

#: SQL can't express the classifier, the verified near-duplicates or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, "stage-" + name.replace(" ", "-"))
    return docs
