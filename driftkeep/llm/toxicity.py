"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features are lexicon densities (a short fixed lexicon, and one of words and
word stems learned from labelled rows), nearness of the second person to them,
capitals, punctuation, digits and obfuscation rates, all over the whole text.

The classifier is fitted on a bounded sample: labelled rows whose
crc32(doc_id as text) mod 5 is not 0, at most about SAMPLE_ROWS of them by a
hash of the id. Half of these teach the lexicon, the rest the trees (three
quarters) and the calibration (one quarter). Labels, lang, source and doc_id
are no inputs of a score.

Defined results: a null text scores as an empty one. A null doc_id counts as
the empty string in the fold rule. Rows are scored one by one, repeated ones
included. Without usable labels every score is the share of label 1 (0 if there
are none). Null labels are left out; an id with several labels is toxic if one
of them is. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.boosted import Boosted, fit
from driftkeep.llm.shared import free_name, lean
from driftkeep.llm.tables import table

#: Bound of the labelled rows that the classifier is fitted on, and of the learned lexicon.
SAMPLE_ROWS, LEXICON_SIZE = 20_000, 4000
#: Common insults in English, German, French and Spanish.
INSULTS = frozenset("idiot moron stupid scum trash clown loser pathetic worthless disgusting dumb fool garbage filth dummkopf abschaum versager widerlich connard imbécile ordure crétin dégoûtant imbécil basura escoria asqueroso".split())
#: The second person.
YOU = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre ti tus vosotros usted".split())
_WORDS = re.compile(r"[^\W\d_]+").findall
_MASKED = re.compile(r"(?<!\w)[0-9@$!]?[^\W\d_]+(?:[0-9@$*!.][^\W\d_]+)+")
_SPACED = re.compile(r"(?:\b[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
_RUNS = re.compile(r"([^\W\d_])\1\1+")
_PLAIN = str.maketrans({"1": "i", "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None})
_KINDS = np.zeros((4, 256), np.int64)
_KINDS[0, 65:91] = 1
_KINDS[1, [33, 63]] = 1
_KINDS[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_KINDS[3, 48:58] = 1
_STEMS = (4, 5, 6)


def stems(word: str) -> list[str]:
    """A word and its marked prefixes."""
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n)]


class Features:
    """Dense features of a text, given the learned lexicon (stem to log-odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """0 for an ordinary word; known words are looked up once, in a table that is emptied when large."""
        w = self._known.get(word)
        if w is None:
            if len(self._known) > 100_000:
                self._known.clear()
            w = self._known[word] = max(self.lexicon.get(s, 0.0) for s in stems(word))
        return w

    def of(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORDS(low)
        n = len(words) + 1
        distinct = Counter(words)
        hits = {w: c for w, c in distinct.items() if self.weight(w) > 0}
        fixed = sum(c for w, c in distinct.items() if w in INSULTS)
        total = sum(hits.values())
        second = sum(c for w, c in distinct.items() if w in YOU)
        near = 0
        if second and (total or fixed):
            at = [i for i, w in enumerate(words) if w in hits or w in INSULTS]
            near = sum(any(w in YOU for w in words[max(0, i - 5) : i + 6]) for i in at)
        masked = _MASKED.findall(low) if any(c in low for c in "@$*!0134.") else []
        plain = [m.translate(_PLAIN) for m in masked]
        veiled = sum(w in INSULTS or self.weight(w) > 0 for w in plain)
        spaced = [re.sub(r"[ .\-_*]", "", m) for m in _SPACED.findall(low)]
        veiled += sum(w in INSULTS or self.weight(w) > 0 for w in spaced)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        kinds = _KINDS @ raw / (len(text) + 1)
        best = max((self.weight(w) for w in hits), default=0.0)
        return [
            float(np.log1p(n)), fixed / n, float(min(fixed, 20)), total / n, float(min(total, 40)), float(min(len(hits), 40)),
            best, sum(self.weight(w) * c for w, c in hits.items()) / n**0.5, near / n, float(min(near, 20)), second / n,
            *kinds.tolist(), len(masked) / n, float(min(veiled, 20)), len(spaced) / n, len(_RUNS.findall(low)) / n, len(distinct) / n,
        ]


N_FEATURES = len(Features({}).of("a"))


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text, y and a hash in [0, 1) of at most about max_rows training rows; the text is read in place."""
    y = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y"))
    y = y.filter(fold("__id") != 0).groupBy("__id").agg(F.max("__y").alias("__y"))
    unit = lambda salt: F.pmod(F.xxhash64("__id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    share = min(1.0, max_rows / max(1, y.count()))
    chosen = y.filter(unit(1) < share).withColumn("__u", unit(2))
    # The broadcast side holds about max_rows ids, whatever the size of the corpus.
    return docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id").select("text", "__y", "__u")


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words and stems whose document odds in toxic rows are over 12 times those in clean rows."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[str, list[int]] = {}
        for pdf in batches:
            for text, y in zip(pdf.text, pdf["__y"], strict=True):
                for s in {s for w in set(_WORDS((text or "").lower())) for s in stems(w)}:
                    tally.setdefault(s, [0, 0])[int(y > 0)] += 1
            if len(tally) > 100_000:
                yield pd.DataFrame([(k, *v) for k, v in tally.items()], columns=["stem", "n0", "n1"])
                tally = {}
        yield pd.DataFrame([(k, *v) for k, v in tally.items()], columns=["stem", "n0", "n1"])

    n1, n0 = sample.agg(F.sum(F.col("__y")), F.sum(1 - F.col("__y"))).first()
    n1, n0 = n1 or 0, n0 or 0
    if not n1 or not n0:
        return {}
    found = sample.select("text", "__y").mapInPandas(lean(counts), "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    top = found.filter(F.col("n1") >= max(3, n1 // 400)).withColumn("odds", odds).filter(F.col("odds") >= 2.5).orderBy(F.desc(F.col("odds") * F.log1p("n1")), "stem").limit(size)
    return {r.stem: float(r.odds) for r in top.select("stem", "odds").collect()}


def _featurizer(lexicon: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Features(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["__y"], "u": pdf["__u"], "x": [make.of(t or "") for t in pdf.text]})

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], Boosted]:
    """The learned lexicon and the calibrated model."""
    sample = labelled_sample(docs, labels, max_rows)
    lexicon = learn_lexicon(sample.filter(F.col("__u") < 0.5))
    rows = sample.filter(F.col("__u") >= 0.5).mapInPandas(lean(_featurizer(lexicon)), "y int, u double, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.u, r.y))
    x = np.array([r.x for r in rows]).reshape(len(rows), N_FEATURES)
    return lexicon, fit(x, np.array([int(r.y > 0) for r in rows]), np.array([r.u >= 0.875 for r in rows], bool))


def score(docs: DataFrame, lexicon: dict[str, float], model: Boosted) -> DataFrame:
    """The input's columns, which pass as they are, and ``toxicity``, a score from 0 to 1, in input order."""
    name = free_name("toxicity", docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(lexicon)
        for batch in batches:
            # A few texts at a time become Python strings.
            texts = batch.column(at)
            parts = [model.score(np.array([make.of(t or "") for t in texts.slice(a, 256).to_pylist()])) for a in range(0, batch.num_rows, 256)]
            scores = pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(run), docs.withColumn(name, F.lit(0.0)).schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, *train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
