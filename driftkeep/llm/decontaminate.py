"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lowered. Each
mask is a fixed window with some positions ignored; a hash of the others is
equal for two windows that differ at ignored positions alone. Hashes of all
benchmark windows are joined with those of all training windows; around each
hit the whole benchmark item is laid over the document on that diagonal and
counted token by token.

A document is contaminated by an item if at least IDENTITY of a run of
max(MIN_TOKENS, COVER of the item's tokens) consecutive aligned tokens agree
(all tokens of shorter items). MASKS, and SHORT_MASKS for items of under
MIN_TOKENS tokens, are such that every run that this accepts holds a hit of one
mask, wherever its substitutions are; a test proves it for all lengths to 300.

The benchmark's hashes are broadcast, which are counted first: at most
BROADCAST_WINDOWS of them at a time. A larger benchmark is dealt into as many
parts, and the documents are read once for each, so neither a common seed nor a
pair of long texts is ever exchanged.

Defined results: null or empty texts have no tokens and no matches. An item of
fewer than SPAN tokens is matched as a whole, exactly. Each (doc_id, item_id)
is returned once with its best run, repeated rows included. An empty table on
either side gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import bounded, free_name, map_pandas, stash
from driftkeep.llm.tables import table
from driftkeep.llm.words import NON_ALNUM, batch_words, doc_words, mix

#: 1 counts, 0 is ignored. Found by search: every placing of 2
#: substitutions in 13 tokens, 3 in 15, 4 in 20 or 5 in 25 leaves some mask a hit,
#: and of 1 in 6 or 2 in 10 some short mask.
MASKS = ("111111", "1110111", "11101011", "101101011", "1010110011", "11010001011")
SHORT_MASKS = ("1111", "11011")
SPAN = 6
MIN_TOKENS, COVER, IDENTITY = 13, 0.5, 0.8
BROADCAST_WINDOWS = 4_000_000
PAIRS = "doc_id long, item_id long, n_matched long, n_aligned long, n_item_tokens long"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def seeds(h: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask its number and the hash of every window of a token sequence."""
    for mask in masks:
        m = (MASKS + SHORT_MASKS).index(mask)
        n = len(h) - len(mask) + 1
        if n > 0:
            x = np.full(n, m + 1, np.uint64)
            for i, c in enumerate(mask):
                if c == "1":
                    x = mix(x * _STEP + h[i : i + n])
            yield m, x


def tokens(text: str | None) -> np.ndarray:
    return doc_words((text if isinstance(text, str) else "").encode("utf-8", "replace"), NON_ALNUM)[0]


def needed(size: int) -> int:
    """Tokens of the run that is judged, for an item of ``size`` tokens."""
    return size if size < MIN_TOKENS else max(MIN_TOKENS, int(np.ceil(COVER * size)))


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Agreeing and aligned tokens of the best run on a diagonal (item position + diagonal = document position)."""
    need = needed(len(item))
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi - lo < need:
        return 0, 0
    same = (doc[lo + diagonal : hi + diagonal] == item[lo:hi]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(same)])
    window = total[need:] - total[:-need]
    best = int(window.max())
    return (best, need) if best >= IDENTITY * need else (0, 0)


class Seeds:
    """The benchmark's hashes, sorted, with the items and positions they come from."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items, self.masks = items, ()
        hs, its, pos = [], [], []
        self.short: dict[int, list[int]] = defaultdict(list)
        for k, (_, h) in enumerate(items):
            if 0 < len(h) < SPAN:
                self.short[len(h)].append(k)
            masks = MASKS if len(h) >= MIN_TOKENS else SHORT_MASKS if len(h) >= SPAN else ()
            self.masks += tuple(m for m in masks if m not in self.masks)
            for _, x in seeds(h, masks):
                hs.append(x)
                its.append(np.full(len(x), k))
                pos.append(np.arange(len(x)))
        h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate(its)[order] if its else np.empty(0, np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.empty(0, np.int64)
        # A bit per 20-bit prefix spares most windows the search.
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hash >> np.uint64(42)] = True
        sizes = np.array([len(x) for _, x in items], np.int64)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.flat = np.concatenate([x for _, x in items]) if items else np.empty(0, np.uint64)
        self.least = np.ceil(IDENTITY * np.array([needed(n) for n in sizes.tolist()])).astype(np.int64)

    def agreeing(self, h: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether enough tokens agree on each (item, diagonal), all of them compared at once."""
        n = self.size[k]
        row = np.repeat(np.arange(len(k)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = d[row] + j
        same = (h[np.clip(at, 0, len(h) - 1)] == self.flat[self.start[k][row] + j]) & (at >= 0) & (at < len(h))
        return np.bincount(row, same, len(k)) >= self.least[k]

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every hit in a token sequence around which enough tokens agree."""
        found: set[tuple[int, int]] = set()
        for _, x in seeds(h, self.masks):
            at = np.flatnonzero(self.seen[x >> np.uint64(42)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hash, x[at], "left"), np.searchsorted(self.hash, x[at], "right")
            n = hi - lo
            if n.any():
                rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs = np.unique(np.stack([self.item[rows], np.repeat(at, n) - self.pos[rows]], 1), axis=0)
                for a in range(0, len(pairs), 20_000):
                    part = pairs[a : a + 20_000]
                    found.update(map(tuple, part[self.agreeing(h, part[:, 0], part[:, 1])].tolist()))
        for size, ks in self.short.items():
            for k in ks:
                item = self.items[k][1]
                ok = np.ones(max(0, len(h) - size + 1), bool)
                for i in range(size):
                    ok &= h[i : i + len(ok)] == item[i]
                found.update((k, int(d)) for d in np.flatnonzero(ok))
        return found


def _matches(docs_pdf: pd.DataFrame, index: Seeds) -> pd.DataFrame:
    out = []
    texts = ((t if isinstance(t, str) else "").encode("utf-8", "replace") for t in docs_pdf.text)
    ids, at = docs_pdf.doc_id.to_numpy(), 0
    for n, h, off in batch_words(texts, NON_ALNUM):
        # Hits across the border of two texts of a group fall to the check of bounds.
        by_doc: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, d in index.hits(h):
            size = len(index.items[k][1])
            first = int(np.searchsorted(off, max(d, 0), "right")) - 1
            last = int(np.searchsorted(off, min(d + size, len(h)) - 1, "right")) - 1
            for doc in range(first, min(last, n - 1) + 1):
                by_doc[doc].add((k, d - int(off[doc])))
        for doc, pairs in by_doc.items():
            best: dict[int, tuple[int, int]] = {}
            for k, d in pairs:
                got = best_run(h[off[doc] : off[doc + 1]], index.items[k][1], d)
                if got[1] and got > best.get(k, (0, 0)):
                    best[k] = got
            out += [(ids[at + doc], index.items[k][0], a, b, len(index.items[k][1])) for k, (a, b) in best.items()]
        at += n
    return pd.DataFrame(out, columns=["doc_id", "item_id", "n_matched", "n_aligned", "n_item_tokens"])


def _window_count(bench: DataFrame) -> int:
    """An upper bound of the benchmark's windows: a token has a byte at least, and a separator."""
    return (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 * len(MASKS)


def contaminated_pairs(docs: DataFrame, bench: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_matched, n_aligned, n_item_tokens of every contaminated pair."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-_window_count(bench) // broadcast_windows))
    found = _scan(docs, bench) if parts == 1 else None
    for i in range(parts if parts > 1 else 0):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        now = stash(_scan(docs, part), "decon-part")
        found = now if found is None else found.unionByName(now)
    best = F.max(F.struct("n_matched", "n_aligned", "n_item_tokens")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def _scan(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The matches of a part of the benchmark that is small enough to broadcast."""
    items = [(None if r.item_id is None else str(r.item_id), tokens(r.text)) for r in bench.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Seeds(shared.value)
        for pdf in batches:
            yield _matches(pdf, index)

    return map_pandas(docs, scan, PAIRS, ("doc_id", "item_id"))


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents without any contaminated pair. A null doc_id stays."""
    bad = free_name("bad", docs)
    found = stash(contaminated_pairs(docs, bench).select(F.col("doc_id").alias(bad)).distinct(), "decon-bad")
    return docs.join(bounded(found), docs["doc_id"] == F.col(bad), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
