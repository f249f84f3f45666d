"""Removal of long repeated byte strings by enhanced suffix arrays.

Every LENGTH-byte string that starts at two or more places of the corpus is
removed wherever it is, documents being the borders.

1. Each window of LENGTH bytes chooses the smallest hash of its SEED-byte
   strings, the leftmost at a tie. Equal windows choose alike, so they meet
   under one hash, at one offset from it. Neighbouring windows mostly choose
   the same place: a document has about 2 choices in LENGTH - SEED bytes. A
   choice with the windows that made it is an anchor; its span is the text of
   those windows. Neighbouring anchors with equal contents, as in a run of one
   byte or of a short period, are one row with a number of times.
2. Anchors are counted by hash. Spans with equal content (a 128-bit BLAKE2b
   digest of the bytes and the place of the anchor) count as one with a number
   of occurrences, so groups of copies shrink before they are exchanged. A hash
   met once is no repeat; a content met twice is repeated as a whole.
3. Where a hash has different contents, one span of each is fetched and an
   enhanced suffix array of the group's spans is built: suffixes sorted to
   LENGTH bytes by prefix doubling, common prefixes of neighbours, and the
   tree of common-prefix intervals by a stack scan. An interval of at least
   LENGTH whose suffixes differ in what precedes them (a text border differs
   from all) is a maximal repeat; it is output with all of its occurrences, and
   covers its windows there. A group of over GROUP spans isn't given to one
   task: equal windows agree in their distance from the anchor, so spans are
   cut into parts of STEPS neighbouring distances, and digests of their bytes
   are exchanged. Parts with equal contents are repeated whole; a part goes on
   in smaller parts only while another content agrees in the bytes that all
   windows at its distances have. Single windows come last, and no array is
   needed.
4. The covered windows of each document are united and cut out.

Defined results: a null or empty text has 0 bytes and nothing to remove. Texts
shorter than LENGTH keep all. Equal rows are repeats of one another. A removal
can split a character, so what is kept is returned as bytes. Only doc_id and
text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import map_pandas, numbered, stash
from driftkeep.llm.tables import table
from driftkeep.llm.words import BYTE_VALUES, POWERS, mix

LENGTH, SEED = 400, 48
#: Spans that one suffix array takes (some 2 MB of text and 250 MB of arrays), and bytes of text that anchors are sought in at a time.
GROUP, PIECE = 2500, 1 << 20
#: Distances from the anchor that a part of a crowded span has at most, round by round.
STEPS = (64, 8, 1)
ANCHORS = "row long, key long, at int, lead int, n_windows int, content binary, times int"


def _hashes(buf: np.ndarray, size: int, prefix: np.ndarray) -> np.ndarray:
    """Hash of every string of ``size`` bytes."""
    _, down = POWERS.get(len(buf) + 1)
    return mix((prefix[size:] - prefix[:-size]) * down[: len(buf) - size + 1])


def _prefix(buf: np.ndarray) -> np.ndarray:
    up, _ = POWERS.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[buf] * up[1:], out=out[1:])
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts [start, end) of a buffer: text, hash, place, first window, number of windows, content, times it follows itself."""
    none = np.empty(0, np.int64)
    if len(buf) < LENGTH:
        return none, none.astype(np.uint64), none, none, none, none.astype(object), none
    prefix = _prefix(buf)
    h = _hashes(buf, SEED, prefix)
    # 40 bits of hash, then the place: the smallest value is the leftmost smallest hash.
    places = _sliding_min((h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64), LENGTH - SEED + 1) & np.uint64((1 << 24) - 1)
    places = places.astype(np.int64)
    n_windows = np.maximum(ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), n_windows)
    window = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows - starts, n_windows)
    chosen = places[window]
    head = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])) if len(text) else none
    count = np.diff(np.append(head, len(text)))
    first, at = window[head], chosen[head]
    lead, key, data = at - first, mix(h[at]), buf.tobytes()
    content = np.empty(len(head), object)
    content[:] = [_digest(b"%d:" % d + data[a : a + n + LENGTH - 1]) for a, n, d in zip(first.tolist(), count.tolist(), lead.tolist(), strict=True)]
    own = np.ones(len(head), bool)
    if len(head):
        own[1:] = (content[1:] != content[:-1]) | (key[1:] != key[:-1]) | (text[head[1:]] != text[head[:-1]])
    times = np.diff(np.append(np.flatnonzero(own), len(head)))
    return text[head][own], key[own], at[own], first[own], count[own], content[own], times


def _texts(column: pd.Series) -> list[bytes]:
    return [(t if isinstance(t, str) else "").encode("utf-8", "replace") for t in column]


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of whole texts; a long text goes in pieces that overlap by a window less one byte."""

    def emit(rows: list[int], parts: list[bytes], shift: list[int]) -> pd.DataFrame:
        size = np.array([len(p) for p in parts])
        ends = np.cumsum(size)
        text, key, at, first, count, content, times = anchors(np.frombuffer(b"".join(parts), np.uint8), ends - size, ends)
        base = (ends - size - np.array(shift))[text]
        return pd.DataFrame({"row": np.array(rows, np.int64)[text], "key": key.view(np.int64), "at": at - base, "lead": at - first, "n_windows": count, "content": content, "times": times})

    for pdf in batches:
        rows, parts, shift, held = [], [], [], 0
        for row, data in zip(pdf.row, _texts(pdf.text), strict=True):
            for a in range(0, max(1, len(data) - LENGTH + 1), PIECE):
                piece = data[a : a + PIECE + LENGTH - 1]
                rows.append(row)
                parts.append(piece)
                shift.append(a)
                held += len(piece)
                if held >= PIECE:
                    yield emit(rows, parts, shift)
                    rows, parts, shift, held = [], [], [], 0
        if parts:
            yield emit(rows, parts, shift)


def suffix_array(buf: np.ndarray, text: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of many texts, those of a group together and sorted, and common prefixes with the one before.

    ``text`` holds the text of each byte, ``ends`` where the texts end and
    ``group`` their groups, ascending from 0. Ranks start from a group and six
    bytes and double in length until all suffixes are told apart or end.
    """
    n = len(buf)
    left = ends[text] - np.arange(n)
    longest = int(left.max())
    padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(6):
        key = key * 257 + np.where(left > i, padded[i : i + n] + 1, 0)
    # Group and six bytes together: 257**6 < 2**49, groups of one call < 2**14.
    key += group[text] * np.int64(257**6)
    ladder: list[tuple[int, np.ndarray]] = []
    done = 6
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int32)]))
        ladder.append((done, rank))
        if done >= longest or int(rank[order[-1]]) == n - 1:
            break
        nxt = np.zeros(n, np.int64)
        ok = np.flatnonzero(left > done)
        nxt[ok] = rank[ok + done].astype(np.int64) + 1
        key = rank.astype(np.int64) * (n + 1) + nxt
        done *= 2
    sa = order
    a, b = sa[:-1].copy(), sa[1:].copy()
    most = np.minimum(left[a], left[b])
    most[group[text[a]] != group[text[b]]] = 0
    common = np.zeros(n - 1, np.int64)
    for size, r in reversed(ladder):
        # Within ``most`` a rank speaks for ``size`` bytes that both have.
        while True:
            fits = np.flatnonzero(common + size <= most)
            fits = fits[r[a[fits]] == r[b[fits]]]
            if not len(fits):
                break
            common[fits] += size
            a[fits] = np.minimum(a[fits] + size, n - 1)
            b[fits] = np.minimum(b[fits] + size, n - 1)
    # Under six bytes are left to compare, which can't matter beyond these.
    for _ in range(5):
        fits = np.flatnonzero(common < most)
        fits = fits[buf[a[fits]] == buf[b[fits]]]
        common[fits] += 1
        a[fits] = np.minimum(a[fits] + 1, n - 1)
        b[fits] = np.minimum(b[fits] + 1, n - 1)
    return sa, np.concatenate([[0], common])


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences) of every maximal repeat of at least ``least``, by a stack scan of the common prefixes.

    ``before`` is what precedes each suffix, below 0 and unlike any other at a
    border. An interval all of whose suffixes are preceded by one byte can be
    extended to the left: it isn't maximal, and its extension covers it.
    """
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    many = -(1 << 62)
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for run in np.split(deep, cuts):
        first, last = int(run[0]), int(run[-1])
        if first == last:
            x, y = sa[first - 1], sa[first]
            if before[x] != before[y]:
                yield int(lcp[first]), sa[first - 1 : first + 1]
            continue
        heights = [*lcp[first : last + 1].tolist(), 0]
        prior = before[sa[first - 1 : last + 1]].tolist()
        stack: list[list[int]] = []  # common prefix, first rank of the interval, the one preceding byte or ``many``
        for i, height in enumerate(heights):
            start, seen = first - 1 + i, prior[i]
            while stack and stack[-1][0] > height:
                size, start, own = stack.pop()
                seen = own if own == seen else many
                if seen == many:
                    yield size, sa[start : first + i]
                if stack and stack[-1][0] >= height:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else many
                    seen = stack[-1][2]
            if height >= least and (not stack or stack[-1][0] < height):
                stack.append([height, start, seen])
            elif stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else many


def repeat_groups(spans: list[bytes], group: list[int] | None = None, least: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of at least ``least`` bytes among the texts of a group: its length and all (text, offset)."""
    keep = [i for i, x in enumerate(spans) if x]
    if not keep:
        return
    size = np.array([len(spans[i]) for i in keep], np.int64)
    ends = np.cumsum(size)
    buf = np.frombuffer(b"".join(spans[i] for i in keep), np.uint8)
    text = np.repeat(np.arange(len(keep)), size)
    sa, lcp = suffix_array(buf, text, ends, np.array([group[i] for i in keep]) if group else np.zeros(len(keep), np.int64))
    before = np.concatenate([[0], buf[:-1]]).astype(np.int64)
    before[ends - size] = -1 - np.arange(len(keep))
    first = ends - size
    for n, where in maximal_repeats(sa, lcp, before, least):
        yield n, [(keep[t], int(w - first[t])) for t, w in zip(text[where].tolist(), where.tolist(), strict=True)]


def _repeated_runs(spans: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first window, number) of the runs of repeated windows of spans of at least LENGTH bytes."""
    size = np.array([len(x) for x in spans], np.int64)
    ends = np.cumsum(size)
    first = ends - size
    buf = np.frombuffer(b"".join(spans), np.uint8)
    text = np.repeat(np.arange(len(spans)), size)
    sa, lcp = suffix_array(buf, text, ends, group)
    before = np.concatenate([[0], buf[:-1]]).astype(np.int64)
    before[first] = -1 - np.arange(len(spans))
    change = np.zeros(len(buf) + 1, np.int64)
    for n, where in maximal_repeats(sa, lcp, before, LENGTH):
        np.add.at(change, where, 1)
        np.add.at(change, where + (n - LENGTH + 1), -1)
    inside = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    # Windows end LENGTH - 1 bytes before their span does, so no run leaves its span.
    return text[start], start - first[text[start]], stop - start


RUNS = "row long, start long, n long"


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows of the spans that stand for one place; rows come sorted by key."""

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys = pdf.key.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        bytes_ = np.cumsum(pdf.span.map(len).to_numpy())
        a = 0
        while a < len(heads):
            base = bytes_[heads[a] - 1] if heads[a] else 0
            b = a + 1
            while b < len(heads) and b - a < 8000 and bytes_[(heads[b + 1] if b + 1 < len(heads) else len(pdf)) - 1] - base < 400_000:
                b += 1
            lo, hi = heads[a], heads[b] if b < len(heads) else len(pdf)
            part = pdf.iloc[lo:hi]
            group = np.cumsum(np.isin(np.arange(lo, hi), heads[a:b])) - 1
            span, first, n = _repeated_runs(part.span.tolist(), group)
            own = part.single.to_numpy()[span]
            yield pd.DataFrame({"row": part.row.to_numpy()[span][own], "start": (part.start.to_numpy()[span] + first)[own], "n": n[own]})
            a = b

    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(pdf.key.to_numpy(), pdf.key.iloc[-1], "left"))
        held = pdf.iloc[cut:]
        if cut:
            yield from work(pdf.iloc[:cut])
    if held is not None and len(held):
        yield from work(held)


PIECES = "key long, row long, at long, low int, core binary, lead int, n_windows int, content binary, start long, single boolean"


def _pieces(step: int):
    """Parts of spans whose windows are at ``step`` neighbouring distances from the anchor at most, with digests of the bytes that all windows at these distances have (core) and of all bytes of the part (content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, row, at, start, lead, n, single, span in pdf[["key", "row", "at", "start", "lead", "n_windows", "single", "span"]].itertuples(index=False, name=None):
                anchor, least = start - at + lead, lead - n + 1
                for low in range(least // step * step, lead + 1, step):
                    high = min(low + step - 1, LENGTH - SEED)
                    last, first = max(least, low), min(lead, high)
                    core, content = _digest(span[anchor - low : anchor - high + LENGTH]), _digest(span[anchor - first : anchor - last + LENGTH])
                    out.append((key, row, at, low, core, first, first - last + 1, content, start + lead - first, single))
            yield pd.DataFrame(out, columns=["key", "row", "at", "low", "core", "lead", "n_windows", "content", "start", "single"])

    return run


def _crowded_runs(crowd: DataFrame) -> DataFrame:
    """row, start, n: repeated runs of the spans (key, row, start, lead, n_windows, single, span) of large groups.

    Parts with equal contents are repeated whole, and one stands for them from
    then on. A part whose core no other content has holds no repeat. The rest
    goes on in smaller parts, down to single windows.
    """
    spans = crowd.select("key", "row", F.col("start").alias("at"), "span")
    left, runs = crowd.select("key", "row", F.col("start").alias("at"), "start", "lead", "n_windows", "single"), None
    for step in STEPS:
        pieces = stash(left.join(spans, ["key", "row", "at"]).mapInPandas(_pieces(step), PIECES), "suffix-pieces")
        one = F.min(F.struct("row", "at", "start", "single")).alias("one")
        same = ["key", "low", "core", "lead", "n_windows", "content"]
        contents = stash(pieces.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), one), "suffix-piece-contents")
        found = pieces.filter("single").join(contents.filter("n > 1").select(*same), same).select("row", "start", F.col("n_windows").cast("long").alias("n"))
        runs = found if runs is None else runs.unionByName(found)
        mixed = contents.groupBy("key", "low", "core").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").drop("d")
        left = stash(contents.join(mixed, ["key", "low", "core"]).select("key", "one.row", "one.at", "one.start", "lead", "n_windows", F.expr("n = 1 and one.single").alias("single")), "suffix-parts")
        if left.isEmpty():
            break
    return runs


def repeated_runs(docs: DataFrame) -> DataFrame:
    """row, start, n: runs of windows that are repeated, of documents with the columns row and text."""
    found = stash(docs.mapInPandas(_find, ANCHORS), "suffix-anchors")
    same = ["key", "lead", "n_windows", "content"]
    contents = stash(found.groupBy(*same).agg(F.sum("times").alias("n"), F.min(F.struct("row", "at")).alias("one")), "suffix-contents")
    copies = contents.filter("n > 1").select(*same)
    whole = found.join(copies, same).select("row", (F.col("at") - F.col("lead")).cast("long").alias("start"), (F.col("n_windows").cast("long") * F.col("times")).alias("n"))
    mixed = contents.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    wanted = contents.join(mixed, "key").select("key", F.col("one.row").alias("row"), (F.col("one.at") - F.col("lead")).cast("long").alias("start"), "lead", "n_windows", (F.col("n") == 1).alias("single"), (F.col("d") > GROUP).alias("crowded"))
    body = F.col("text").cast("binary")
    cut = F.expr(f"substring(cast(text as binary), cast(start as int) + 1, n_windows + {LENGTH - 1})")
    spans = stash(wanted.join(docs.filter(F.length(body) >= LENGTH), "row").select("key", "row", "start", "lead", "n_windows", "single", "crowded", cut.alias("span")), "suffix-spans")
    sorted_ = spans.filter("not crowded").select("key", "row", "start", "single", "span").repartition("key").sortWithinPartitions("key")
    runs = whole.unionByName(sorted_.mapInPandas(_arrays, RUNS))
    crowd = spans.filter("crowded")
    if crowd.isEmpty():
        return runs
    return runs.unionByName(_crowded_runs(crowd))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, data, runs in zip(pdf.doc_id, _texts(pdf.text), pdf.runs, strict=True):
            if runs is None or not len(runs):
                out.append((doc_id, len(data), 0, 0, data))
                continue
            r = np.array([(x["start"], x["n"]) for x in runs], np.int64)
            r = r[np.argsort(r[:, 0], kind="stable")]
            end = np.maximum.accumulate(r[:, 0] + r[:, 1] + LENGTH - 1)
            head = np.flatnonzero(np.concatenate([[True], r[1:, 0] > end[:-1]]))
            start, stop = r[head, 0], end[np.append(head[1:] - 1, len(r) - 1)]
            kept = b"".join(data[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(data)], strict=True))
            out.append((doc_id, len(data), len(data) - len(kept), len(head), kept))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    runs = repeated_runs(rows.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return map_pandas(rows.join(runs, "row", "left").select("doc_id", "text", "runs"), _cut, CUT, ("doc_id",))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the bytes that are kept as text (a character that a removal splits shows as U+FFFD)."""
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
