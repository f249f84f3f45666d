"""Searches by one pass over the base: the k best of each query so far, in memory that doesn't grow with the base.

The base is dealt by item id to a number of tasks that follows the cores, each
sorted by id. A task holds its queries, their k best and one block of scores,
and gives k rows a query at its end, so pairs of queries and items are made in
memory only, and what is exchanged is the base once and k rows a query and task.

A product of matrices with some room for rounding finds who may be among the k
best; the scores that count are sums in a fixed order, so equal vectors tie and
go by id. Of items that are alike only the first k by id are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftkeep.functions import hashing
from driftkeep.operators import blocks

#: Queries that are broadcast at most, base rows of a tile beyond that, base rows of a block, scores of a block, tasks a core.
QUERY_ROWS, GROUP_ROWS, BLOCK_ROWS, SCORES, TASKS = 25_000, 100_000, 8192, 2_000_000, 2
FOUND = ["query_id", "item_id", "score"]
_LAST = np.iinfo(np.int64).max


class Best:
    """The k best items of each query so far, ties to the smaller id; ``more`` is a second score that goes along."""

    def __init__(self, n: int, k: int, unique: bool = False):
        self.k, self.unique = k, unique
        self.ids, self.scores, self.more = np.full((n, k), _LAST), np.full((n, k), -np.inf), np.zeros((n, k))

    def offer(self, x: np.ndarray, ids: np.ndarray, scores: np.ndarray, more: np.ndarray) -> None:
        if not len(x):
            return
        u, at = np.unique(x, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(u)), self.k), at])
        i, s, m = (np.concatenate([old[u].ravel(), new]) for old, new in ((self.ids, ids), (self.scores, scores), (self.more, more)))
        there = s > -np.inf
        rows, i, s, m = rows[there], i[there], s[there], m[there]
        if self.unique:  # an item counts by its best copy
            order = np.lexsort((-s, i, rows))
            rows, i, s, m = rows[order], i[order], s[order], m[order]
            first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (i[1:] != i[:-1])])
            rows, i, s, m = rows[first], i[first], s[first], m[first]
        order = np.lexsort((i, -s, rows))
        rows, i, s, m = rows[order], i[order], s[order], m[order]
        rank = ranks(rows)
        keep = rank < self.k
        for held, new, empty in ((self.ids, i, _LAST), (self.scores, s, -np.inf), (self.more, m, 0.0)):
            part = np.full((len(u), self.k), empty)
            part[rows[keep], rank[keep]] = new[keep]
            held[u] = part

    def found(self) -> tuple[np.ndarray, ...]:
        """Places of queries, ids, scores and second scores."""
        x, y = np.nonzero(self.scores > -np.inf)
        return x, self.ids[x, y], self.scores[x, y], self.more[x, y]


def ranks(rows: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal ones."""
    at = np.arange(len(rows))
    head = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, bool)
    return at - np.maximum.accumulate(np.where(head, at, 0)) if len(rows) else at


def firsts(ids: np.ndarray, alike: np.ndarray, k: int, unique: bool = False) -> np.ndarray:
    """Places of the first k by id (they ascend) of the rows that are alike in every column, of different ids with ``unique``."""
    raw = np.ascontiguousarray(alike)
    group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    if unique:
        g, i = group[order], ids[order]
        order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])]
    return np.sort(order[ranks(group[order]) < k])


def choose(best: Best, at: int, near: np.ndarray, ids: np.ndarray, exact: Callable, room: float, allowed: Callable | None = None, dense: Callable | None = None) -> None:
    """Offers to the queries from ``at`` on what their products (queries by items) leave possible.

    ``exact(x, y)`` gives the scores of queries x with items y; ``allowed(x, y)`` and ``dense(x)`` which items they may be compared with, pair by pair and all.
    """
    n, floor = len(ids), best.scores[at : at + len(near), -1] - room
    few = np.flatnonzero(floor == -np.inf)
    floor[few] = np.inf
    x, y = np.nonzero(near >= floor[:, None])
    if len(few):  # queries that don't have k items yet
        part = near[few]
        if dense is not None:
            part[~dense(at + few)] = -np.inf
        least = np.partition(part, n - best.k, axis=1)[:, n - best.k, None] - max(room, 0.0) if n > best.k else -np.inf
        i, j = np.nonzero((part >= least) & (part > -np.inf))
        x, y = np.concatenate([x, few[i]]), np.concatenate([y, j])
    x = at + x
    if allowed is not None:
        kept = allowed(x, y)
        x, y = x[kept], y[kept]
    pairs = [exact(x[i : i + 20_000], y[i : i + 20_000]) for i in range(0, len(x), 20_000)]
    if pairs:
        pairs = [p if isinstance(p, tuple) else (p, np.zeros(len(p))) for p in pairs]
        best.offer(x, ids[y], np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))


def in_order(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows, summed from the first dimension to the last as engines do, so that coarse vectors tie alike."""
    total = lambda parts: np.cumsum(parts, axis=1)[:, -1]
    if metric == "l2":
        return -total((q - v) ** 2)
    return total(q * v) / (np.sqrt(total(q * q)) * np.sqrt(total(v * v))) if metric == "cosine" else total(q * v)


def unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(1, keepdims=True))


def room_for(a: np.ndarray, b: np.ndarray, size) -> float:
    return 1e-9 * (1 + np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0)) + np.max(np.abs(size), initial=0))


class Scan:
    """What a task does: ``make`` has its queries, ``offer`` takes base rows in order of their ids, all of one id together, ``found`` gives columns."""

    def offer(self, ids: np.ndarray, v: np.ndarray, *more) -> None:
        raise NotImplementedError

    def found(self) -> list[np.ndarray]:
        raise NotImplementedError


class Plain(Scan):
    """The k best of all items; with ``unique`` of different ids, each by its best copy."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, metric: str, unique: bool = False):
        self.asked, self.q, self.metric, self.best = asked, q, metric, Best(len(asked), k, unique)

    def offer(self, ids, v):
        keep = firsts(ids, v, self.best.k, self.best.unique)
        ids, v = ids[keep], v[keep]
        size = 0.5 * (v * v).sum(1) if self.metric == "l2" else 0.0
        scored = lambda x, y: in_order(self.q[x], v[y], self.metric)
        each(self.best, self.q, v, size, ids, scored, self.metric)

    def found(self):
        x, ids, scores, _ = self.best.found()
        return [self.asked[x], ids, scores]


def each(best: Best, a: np.ndarray, b: np.ndarray, size, ids: np.ndarray, scored: Callable, metric: str, **which) -> None:
    """``choose`` for all queries, step by step. Products of l2 are half the score and lack the query's length, so floors are taken from there."""
    if metric == "cosine":
        a, b = unit(a), unit(b)
    room = room_for(a, b, size)
    lengths = (a * a).sum(1) if metric == "l2" else None
    for at in range(0, len(a), step := max(1, SCORES // max(1, len(ids)))):
        near = a[at : at + step] @ b.T - size
        if lengths is not None:
            near = 2 * near - lengths[at : at + step, None]
        choose(best, at, near, ids, scored, room * (4 if lengths is not None else 1), **which)


def whole_ids(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """Columns of blocks in which no id goes on in the next one: ids, matrices of vectors, lists as Arrow arrays."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            ids = part.column("item_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield columns(pa.Table.from_batches([*held, part.slice(0, cut)]), names)
                held = []
            held.append(part.slice(cut))
    if held:
        yield columns(pa.Table.from_batches(held), names)


def columns(table: pa.Table, names: list[str]) -> list:
    table = table.combine_chunks()
    out = []
    for name in names:
        c = table.column(name)
        c = c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0) if c.num_chunks else pa.array([], c.type)
        out.append(blocks._matrix(c, len(c)) if name in ("v", "q") and len(c) else np.empty((0, 0)) if name in ("v", "q") else c if pa.types.is_list(c.type) else c.to_numpy())
    return out


def scan(queries: DataFrame, base: DataFrame, make: Callable[..., Scan], names: list[str], schema: str, asked: dict[str, Column] | None = None, given: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """What ``make(query ids, q, further columns of the queries)`` finds for queries (query_id, q) in base (item_id, v), a part from each task.

    Rows without an id or vector take no part; all vectors have one length.
    """
    asked, given = asked or {}, given or {}
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"), *[c.alias(n) for n, c in asked.items()]).filter("query_id is not null and q is not null")
    base = base.select(F.col("item_id").cast("long").alias("item_id"), F.col("v").cast("array<double>").alias("v"), *[c.alias(n) for n, c in given.items()]).filter("item_id is not null and v is not null")
    ask, have = ["query_id", "q", *asked], ["item_id", "v", *given]
    n, size = queries.agg(F.count(F.lit(1)), F.sum(8 + 8 * F.size("q"))).first()
    context = queries.sparkSession.sparkContext
    if n <= QUERY_ROWS and (size or 0) <= blocks.BROADCAST_BYTES:
        shared = context.broadcast(columns(queries.toArrow(), ask))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not len(shared.value[0]):
                return
            machine = make(*shared.value)
            for block in whole_ids(batches, have):
                machine.offer(*block)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in machine.found()], names=names)

        tasks = tasks or max(8, TASKS * context.defaultParallelism)
        return base.repartition(tasks, "item_id").sortWithinPartitions("item_id").mapInArrow(run, schema)
    groups, parts = max(1, -(-base.count() // GROUP_ROWS)), max(1, -(-n // QUERY_ROWS))
    dealt = base.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wide = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        machine = make(*columns(left, ask))
        if left.num_rows:
            for block in whole_ids(right.sort_by("item_id").combine_chunks().to_batches(), have):
                machine.offer(*block)
        return pa.Table.from_arrays([pa.array(c) for c in machine.found()], names=names)

    return wide.groupBy("g", "b").cogroup(dealt.groupBy("g", "b")).applyInArrow(tile, schema)


class Buckets:
    """The buckets that queries probe, as one bit each, and which items lie in one of them."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, dim: int, tables: int, rotations: int, seed: int, n_probes: int, base_probes: int, total: int | None = None):
        self.index, self.base_probes = (dim, tables, rotations, seed), base_probes
        self.width = 2 * hashing.power_of_two(dim)
        found = [self._table(q, t, n_probes) for t in range(tables)]
        code, strength = np.concatenate([c for c, _ in found], 1), np.concatenate([s for _, s in found], 1)
        kept = np.ones(code.shape, bool)
        if total is not None:
            n = code.shape[1]
            row, table, probe = np.repeat(np.arange(len(q)), n), np.tile(np.arange(n) // n_probes, len(q)), np.tile(np.arange(n) % n_probes, len(q))
            order = np.lexsort((probe, table, -strength.ravel(), probe > 0, row))
            kept.ravel()[order] = ranks(row[order]) < total
        self.bits = np.zeros((len(q), self.width * tables + 1), bool)  # the last is of no bucket
        x, y = np.nonzero(kept)
        self.bits[x, code[x, y]] = True
        ids, back = np.unique(asked, return_inverse=True)
        if len(ids) < len(asked):  # rows of one query share what they probe
            shared = np.zeros((len(ids), self.bits.shape[1]), bool)
            np.logical_or.at(shared, back, self.bits)
            self.bits = shared[back]

    def _table(self, v: np.ndarray, t: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        dim, _, rotations, seed = self.index
        z = v @ hashing.rotation(dim, rotations, seed + t).T
        near = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :n]
        at = np.take_along_axis(z, near, 1)
        return t * self.width + 2 * near + (at < 0), np.abs(at)

    def file(self, ids: np.ndarray, v: np.ndarray, filed: pa.Array | None = None) -> np.ndarray:
        """Bits of each item, a row each; ``filed`` has them as lists if they aren't the item's own buckets. Copies of an id share them."""
        none = self.bits.shape[1] - 1
        if filed is None:
            code = np.concatenate([self._table(v, t, self.base_probes)[0] for t in range(self.index[1])], 1)
        else:
            lists = filed.to_pylist()
            code = np.full((len(ids), max(1, *map(len, lists)) if len(lists) > 1 else max(1, len(lists[0]))), none)
            for i, x in enumerate(lists):
                code[i, : len(x)] = x
        copies = np.flatnonzero(ids[1:] == ids[:-1])
        if len(copies):
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            all_ = [np.unique(c) for c in np.split(code, start[1:])]
            wide = np.full((len(start), max(map(len, all_))), none)
            for i, c in enumerate(all_):
                wide[i, : len(c)] = c
            code = wide[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))]
        return code

    def allowed(self, code: np.ndarray) -> Callable:
        return lambda x, y: np.logical_or.reduce([self.bits[x, c[y]] for c in code.T])

    def dense(self, code: np.ndarray) -> Callable:
        def run(x: np.ndarray) -> np.ndarray:
            own = self.bits[x]
            out = np.take(own, code[:, 0], axis=1)
            for c in code.T[1:]:
                out |= np.take(own, c, axis=1)
            return out

        return run


class Probed(Scan):
    """The k best of the items that share a bucket with the query: by ``first`` with the score ``metric`` beside it.

    ``coder`` gives what the first score compares in an item's place.
    """

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, buckets: Buckets, first: str, metric: str, coder: Callable[[np.ndarray], np.ndarray] | None = None):
        self.asked, self.q, self.first, self.metric, self.coder = asked, q, first, metric, coder
        self.buckets, self.best = buckets, Best(len(asked), k)

    def offer(self, ids, v, filed=None):
        code = self.buckets.file(ids, v, filed)
        keep = firsts(ids, np.concatenate([v, code], 1), self.best.k)
        ids, v, code = ids[keep], v[keep], code[keep]
        b = self.coder(v) if self.coder else v
        size = 0.5 * (b * b).sum(1) if self.first == "l2" else 0.0
        same = self.coder is None and self.first == self.metric

        def scored(x, y):
            s = in_order(self.q[x], b[y], self.first)
            return s if same else (s, in_order(self.q[x], v[y], self.metric))

        each(self.best, self.q, b, size, ids, scored, self.first, allowed=self.buckets.allowed(code), dense=self.buckets.dense(code))

    def found(self):
        x, ids, scores, more = self.best.found()
        return [self.asked[x], ids, scores, more]


class Routed(Scan):
    """The k best by inner product of the items in one of the query's regions."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, reach: pa.Array, k: int):
        self.asked, self.q, self.best = asked, q, Best(len(asked), k)
        lists = reach.to_pylist()
        self.lengths = np.array([len(x) for x in lists])
        self.reach = np.zeros((len(q), max([1, *self.lengths])), np.int64)
        for i, x in enumerate(lists):
            self.reach[i, : len(x)] = x

    def offer(self, ids, v, region):
        keep = firsts(ids, np.concatenate([v, region[:, None].view(np.float64)], 1), self.best.k)
        ids, v, region = ids[keep], v[keep], region[keep]
        dense = lambda x: np.logical_or.reduce([(self.reach[x, j][:, None] == region[None, :]) & (j < self.lengths[x])[:, None] for j in range(self.reach.shape[1])])
        allowed = lambda x, y: np.logical_or.reduce([(self.reach[x, j] == region[y]) & (j < self.lengths[x]) for j in range(self.reach.shape[1])])
        each(self.best, self.q, v, 0.0, ids, lambda x, y: in_order(self.q[x], v[y], "ip"), "ip", allowed=allowed, dense=dense)

    def found(self):
        x, ids, scores, _ = self.best.found()
        return [self.asked[x], ids, scores]


class Sweep(Scan):
    """The k best by inner product of the bucket candidates of each setting (tables, probes a table), and how many candidates there are: rows with ``n``."""

    NAMES, SCHEMA = ["cell", *FOUND, "n"], f"cell int, {blocks.FOUND}, n long"

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, settings: list[tuple[int, int]], dim: int, rotations: int, seed: int):
        self.asked, self.q, self.settings = asked, q, settings
        self.buckets = {p: Buckets(asked, q, dim, max(t for t, _ in settings), rotations, seed, p, 1) for p in {p for _, p in settings}}
        self.best, self.n = [Best(len(asked), k) for _ in settings], np.zeros(len(settings), np.int64)
        self.counted = np.zeros(len(asked), bool)  # a query once
        self.counted[np.unique(asked, return_index=True)[1]] = True

    def offer(self, ids, v):
        one = next(iter(self.buckets.values()))
        code, none = one.file(ids, v), one.bits.shape[1] - 1
        keep = firsts(ids, np.concatenate([v, code], 1), self.best[0].k)
        head = np.concatenate([[True], ids[1:] != ids[:-1]])
        near_to, own = v[keep], ids[keep]
        room = room_for(self.q, near_to, 0.0)
        scored = lambda x, y: in_order(self.q[x], near_to[y], "ip")
        met_by = []
        for t, p in self.settings:
            own_code = np.where(code < t * one.width, code, none)
            met_by.append(self.buckets[p].dense(own_code[:, (own_code != none).any(0)]))
        for at in range(0, len(self.q), step := max(1, SCORES // max(1, len(ids)))):
            near, rows = self.q[at : at + step] @ near_to.T, np.arange(at, min(at + step, len(self.q)))
            counted = self.counted[rows]
            for i, dense in enumerate(met_by):
                met = dense(rows)
                once = met if counted.all() else met[counted]
                self.n[i] += np.count_nonzero(once if head.all() else once[:, head])
                met = met if len(keep) == len(ids) else met[:, keep]
                choose(self.best[i], at, near, own, scored, room, lambda x, y, m=met, a=at: m[x - a, y], lambda x, m=met, a=at: m[x - a])

    def found(self):
        out = []
        for i, best in enumerate(self.best):
            x, ids, scores, _ = best.found()
            out.append((np.full(len(x), i, np.int32), self.asked[x], ids, scores, np.zeros(len(x), np.int64)))
        cells = np.arange(len(self.n), dtype=np.int32)
        zeros = np.zeros(len(cells), np.int64)
        return [np.concatenate(c) for c in zip(*out, (cells, zeros, zeros, zeros.astype(float), self.n), strict=True)]


class Cells(Scan):
    """The k best by inner product within each of some sets of items; a row's ``mask`` has a bit for each set that holds it."""

    NAMES, SCHEMA = ["cell", *FOUND], f"cell long, {blocks.FOUND}"

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, cells: int):
        self.asked, self.q, self.best = asked, q, [Best(len(asked), k) for _ in range(cells)]

    def offer(self, ids, v, mask):
        keep = firsts(ids, np.concatenate([v, mask[:, None].view(np.float64)], 1), self.best[0].k)
        ids, v, mask = ids[keep], v[keep], mask[keep]
        within = [np.flatnonzero(mask >> i & 1) for i in range(len(self.best))]
        room = room_for(self.q, v, 0.0)
        for at in range(0, len(self.q), step := max(1, SCORES // max(1, len(ids)))):
            near = self.q[at : at + step] @ v.T
            for best, at_items in zip(self.best, within, strict=True):
                if len(at_items):
                    own = v[at_items]
                    choose(best, at, near if len(at_items) == len(ids) else near[:, at_items], ids[at_items], lambda x, y, own=own: in_order(self.q[x], own[y], "ip"), room)

    def found(self):
        out = []
        for i, best in enumerate(self.best):
            x, ids, scores, _ = best.found()
            out.append((np.full(len(x), i), self.asked[x], ids, scores))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


class Signs(Scan):
    """The k smallest Hamming distances of hyperplane sign codes, as negative scores."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, planes: np.ndarray):
        self.asked, self.planes, self.best = asked, planes, Best(len(asked), k)
        self.codes = self._signs(q)

    def _signs(self, v: np.ndarray) -> np.ndarray:
        return np.where(v @ self.planes.T > 0, np.float32(0.5), np.float32(-0.5))

    def offer(self, ids, v):
        b = 2 * self._signs(v)
        keep = firsts(ids, b, self.best.k)
        ids, b = ids[keep], b[keep]
        # Half a distance orders the ties of a block by id; ids of later blocks are larger, so there only less distance counts.
        size = 0.5 * b.shape[1] + np.arange(len(ids)) / (2 * len(ids))
        for at in range(0, len(self.codes), step := max(1, SCORES // max(1, len(ids)))):
            near = self.codes[at : at + step] @ b.T - size
            choose(self.best, at, near, ids, lambda x, y: np.rint((self.codes[x] * b[y]).sum(1) - 0.5 * b.shape[1]).astype(float), -0.25)

    def found(self):
        x, ids, scores, _ = self.best.found()
        return [self.asked[x], ids, -scores]


class Coded(Scan):
    """The k smallest asymmetric distances to product codes, to nine digits, ties to the smaller id; books are (parts, codes, width)."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, k: int, books: np.ndarray):
        self.books = books
        self.table = np.concatenate([self._distances(q, m) for m in range(len(books))], 1)
        self.asked, back = np.unique(asked, return_inverse=True)
        if len(self.asked) < len(asked):  # rows of one query add up
            table = np.zeros((len(self.asked), self.table.shape[1]))
            np.add.at(table, back, self.table)
            self.table = table
        else:
            self.table = self.table[np.argsort(back)]
        self.best = Best(len(self.asked), k)

    def _distances(self, v: np.ndarray, m: int) -> np.ndarray:
        book, out = self.books[m], 0.0
        for j in range(book.shape[1]):  # in the order in which engines add
            out = out + (v[:, m * book.shape[1] + j, None] - book[None, :, j]) ** 2
        return out

    def codes(self, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id once, and its nearest codeword of each part, ties to the smaller; of copies the nearest one's."""
        head = np.concatenate([[True], ids[1:] != ids[:-1]])
        item, out = np.cumsum(head) - 1, []
        for m in range(len(self.books)):
            d = self._distances(v, m)
            code = d.argmin(1)
            if not head.all():
                order = np.lexsort((code, d[np.arange(len(d)), code], item))
                code = code[order][np.concatenate([[True], item[order][1:] != item[order][:-1]])]
            out.append(code)
        return ids[head], np.stack(out, 1)

    def offer(self, ids, v):
        ids, code = self.codes(ids, v)
        keep = firsts(ids, code, self.best.k)
        ids, code = ids[keep], code[keep]
        n = self.books.shape[1]
        place = code + np.arange(len(self.books)) * n
        b = np.zeros((len(ids), len(self.books) * n))
        b[np.arange(len(ids))[:, None], place] = 1.0

        def scored(x, y):
            out = 0.0
            for m in range(place.shape[1]):
                out = out + self.table[x, place[y, m]]
            return -np.floor(out * 1e9 + 0.5) / 1e9

        room = 2e-9 + 1e-12 * self.table.max(initial=0)
        for at in range(0, len(self.table), step := max(1, SCORES // max(1, len(ids)))):
            choose(self.best, at, -(self.table[at : at + step] @ b.T), ids, scored, room)

    def found(self):
        x, ids, scores, _ = self.best.found()
        return [self.asked[x], ids, -scores]
