"""Question answering from a bounded memory: keep turns, retrieve, answer, judge.

A conversation is a stream of turns. A policy keeps max(int(N * fraction), 5) of
its N turns; for each question the nearest kept turns are the context, from
which an answerer makes a prediction and a judge scores it. Answerer and judge
are functions of Columns, so that a model server can be put in their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkeep.functions.hashing import hash32
from driftkeep.operators import scans
from driftkeep.operators.metrics import answer_score

#: How a policy ranks the turns of a conversation, smallest first; columns pos and turn_id.
RANKS: dict[str, Callable[[], list[Column]]] = {"FIFO": lambda: [-F.col("pos")], "Reservoir": lambda: [hash32("turn_id", 42), F.col("pos")]}
FRACTIONS, LEAST, CONTEXT = (0.1, 0.25, 0.5, 1.0), 5, 5


def questions(turns: DataFrame, *more: str) -> DataFrame:
    """conv_id, query_id (its pos), question and answer, with ``more`` columns of the turn: each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    both = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return both.filter("role = 'user' and next_role = 'assistant'").select("conv_id", F.col("pos").alias("query_id"), F.col("text").alias("question"), "answer", *more)


def kept_turns(turns: DataFrame, fractions: tuple[float, ...] = FRACTIONS, least: int = LEAST) -> DataFrame:
    """policy, fraction, conv_id, item_id (its pos): what each policy keeps under each budget. Turns are ranked once a policy."""
    named = turns.select("conv_id", "pos", F.concat_ws(":", "conv_id", "pos").alias("turn_id"))
    by_conversation = Window.partitionBy("conv_id")
    ranked = named.select("conv_id", "pos", F.count(F.lit(1)).over(by_conversation).alias("n"), *[F.row_number().over(by_conversation.orderBy(*by())).alias(p) for p, by in RANKS.items()])
    ranks = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("rank")) for p in RANKS])
    each = ranked.select("conv_id", "pos", "n", F.explode(ranks).alias("r"), F.array(*[F.lit(f) for f in fractions]).alias("fs"))
    budget = F.greatest(F.floor(F.col("n") * F.col("fraction")), F.lit(least))
    return each.withColumn("fraction", F.explode("fs")).filter(F.col("r.rank") <= budget).select("r.policy", "fraction", "conv_id", F.col("pos").alias("item_id"))


def extract(context: Column) -> Column:
    """The default answerer: all that was retrieved."""
    return F.array_join(context, "\n")


def nearest(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, ties to the smaller place; -1 where there are fewer."""
    out = np.full((len(s), k), -1, np.int32)
    if s.shape[1] <= 64:
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out[:, : near.shape[1]] = near
        return out
    x, y = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    order = np.lexsort((y, -s[x, y], x))
    x, y = x[order], y[order]
    rank = scans.ranks(x)
    out[x[rank < k], rank[rank < k]] = y[rank < k]
    return out


def picked(items: np.ndarray, v: np.ndarray, kept: np.ndarray, mask: np.ndarray, q: np.ndarray, k: int, cells: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For blocks of a conversation's questions and each cell: the first question's place, the cell and places of turns, nearest first."""
    bits = np.zeros(len(items), np.int64)
    at = np.searchsorted(items, kept)
    there = at < len(items)
    there[there] = items[at[there]] == kept[there]
    bits[at[there]] = mask[there]
    held = [np.flatnonzero(bits >> c & 1).astype(np.int32) for c in range(cells)]
    for start in range(0, len(q), step := max(1, scans.SCORES // max(1, len(items)))):
        s, known = np.round(q[start : start + step] @ v.T, 9), {}
        for c, own in enumerate(held):
            if len(own):
                key = own.tobytes()
                if key not in known:
                    near = nearest(s[:, own], k)
                    known[key] = np.where(near >= 0, own[near], -1)
                yield start, c, known[key]


def whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in which no conversation goes on in the next ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        first = held[-1].column("conv_id")[-1].as_py() if held else ids[0]
        changes = np.flatnonzero(np.concatenate([[ids[0] != first], ids[1:] != ids[:-1]]))
        cut = int(changes[-1]) if len(changes) else 0
        if len(changes):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def retrieved(asked: DataFrame, memory: DataFrame, kept: DataFrame, cells: list[tuple], k: int) -> DataFrame:
    """conv_id, place of the question, cell and p0, p1, ...: places of the k nearest kept turns of a question, both in order of their ids, -1 beyond the last.

    A task holds one conversation's vectors and a block of scores; texts stay where they are.
    """
    mask = F.lit(0).cast("long")
    for i, (policy, fraction) in enumerate(cells):
        mask = F.when((F.col("policy") == policy) & (F.col("fraction") == fraction), F.lit(1 << i).cast("long")).otherwise(mask)
    none = F.lit(None).cast("array<double>")
    row = lambda df, kind, i, v, m: df.select("conv_id", F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), v.cast("array<double>").alias("v"), m.alias("mask"))
    marks = kept.groupBy("conv_id", "item_id").agg(F.bit_or(mask).alias("mask"))
    zero = F.lit(0).cast("long")
    rows = row(marks, 0, "item_id", none, F.col("mask")).unionByName(row(memory, 1, "item_id", F.col("v"), zero)).unionByName(row(asked, 2, "query_id", F.col("q"), zero)).filter("conv_id is not null and (kind = 0 or v is not null)")
    places, n = [f"p{i}" for i in range(k)], len(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_conversations(batches):
            conv, kind, ids, mask = (table.column(c).to_numpy() for c in ("conv_id", "kind", "id", "mask"))
            filled = kind > 0
            v = table.column("v").combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            v = v.flatten().to_numpy(zero_copy_only=False).reshape(int(filled.sum()), -1) if filled.any() else np.empty((0, 0))
            at = np.cumsum(filled) - filled
            group = np.concatenate([[0], np.cumsum((conv[1:] != conv[:-1]))])
            edges = np.searchsorted(group * 3 + kind, np.arange(3 * (group[-1] + 1) + 1)).tolist()
            out, size = [], 0
            for g in range(group[-1] + 1):
                a, b, c, d = edges[3 * g : 3 * g + 4]
                if a == b or b == c or c == d:
                    continue
                for start, cell, near in picked(ids[b:c], v[at[b] : at[b] + c - b], ids[a:b], mask[a:b], v[at[c] : at[c] + d - c], k, n):
                    out.append((conv[a], start, cell, near))
                    size += len(near)
                if size > 50_000:
                    yield emit(out)
                    out, size = [], 0
            if out:
                yield emit(out)

    def emit(out: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(x[3]) for x in out])
        near = np.concatenate([x[3] for x in out])
        place = np.concatenate([np.arange(x[1], x[1] + len(x[3]), dtype=np.int32) for x in out])
        conv = np.repeat(np.array([x[0] for x in out]), sizes)
        return pa.RecordBatch.from_arrays([pa.array(conv.tolist() if conv.dtype.kind in "OU" else conv), pa.array(place), pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes)), *(pa.array(np.ascontiguousarray(p)) for p in near.T)], names=["conv_id", "place", "cell", *places])

    tasks = max(8, scans.TASKS * asked.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "kind", "id")
    return dealt.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, place int, cell int, " + ", ".join(f"{p} int" for p in places))


def answered(asked: DataFrame, memory: DataFrame, kept: DataFrame, k: int = CONTEXT, answer: Callable[[Column], Column] = extract, judge: Callable[[Column, Column], Column] = answer_score) -> DataFrame:
    """policy, fraction, conv_id, query_id, score for questions (conv_id, query_id, q, answer) and turns (conv_id, item_id, v, line).

    Vectors are compared conversation by conversation; a conversation's texts
    are exchanged once, as one row, from which the contexts are read by place.
    """
    cells = sorted((r.policy, r.fraction) for r in kept.select("policy", "fraction").distinct().collect())
    if len(cells) > 62:
        raise ValueError("62 policies and budgets at most")
    found = retrieved(asked, memory, kept, cells, k)
    # Rows without a vector take no part, so that places are those of ``retrieved``.
    listed = lambda df, v, i, text, name: df.filter(F.col(v).isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(i, text))).alias(name))
    whole = listed(memory, "v", "item_id", "line", "lines").join(listed(asked, "q", "query_id", "answer", "answers"), "conv_id")
    one = F.get("answers", F.col("place"))
    n = sum((F.when(F.col(f"p{i}") >= 0, 1).otherwise(0) for i in range(k)), F.lit(0))
    context = F.slice(F.array(*[F.get("lines", F.col(f"p{i}"))["line"] for i in range(k)]), F.lit(1), n)
    name = lambda i, kind: F.get(F.array(*[F.lit(c[i]).cast(kind) for c in cells] or [F.lit(None).cast(kind)]), F.col("cell"))
    kinds = dict(kept.dtypes)
    return found.join(whole, "conv_id").select(name(0, kinds["policy"]).alias("policy"), name(1, kinds["fraction"]).alias("fraction"), "conv_id", one["query_id"].alias("query_id"), judge(answer(context), one["answer"]).alias("score"))


def accuracy(answers: DataFrame) -> DataFrame:
    """policy, budget, conv_id, correct, total, accuracy: a row for each conversation and cell."""
    g = answers.groupBy("policy", F.col("fraction").alias("budget"), "conv_id").agg(F.sum("score").cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("accuracy", F.col("correct") / F.col("total"))
