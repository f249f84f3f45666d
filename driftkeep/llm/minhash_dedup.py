"""Near-duplicate classes by MinHash with tensored banding.

M small collections of R minhashes each are computed per distinct shingle set;
a table key is a pair of collections, so M*(M-1)/2 tables of 2*R rows cost M*R
minhashes instead of M*(M-1)*R. Texts with equal sets become one
representative first. Collections that no other representative has make no key,
so a text unlike all others costs M rows and not M*(M-1)/2.

1. Tables give buckets. Within a bucket the set sizes and the minhashes (a byte
   of each) say which members may be linked; the bucket gives a tree over each
   connected part of that graph, at most one row a member. Parts that share
   members over all buckets join to families: no link leaves a family.
2. Families are decided exactly, on full shingle sets. A family is dealt into
   blocks of about BLOCK members or BLOCK_SHINGLES shingles, and each block is
   worked through in memory: links inside one component aren't looked for, and
   only a tree of links is returned. Of each component found one member meets
   those of the other blocks.
3. In a family that still has several components, members outside the largest
   meet each other and the largest, block against block, a task for a tile. So
   no pair of two components is left out, and none is ever a row: compute grows
   with the product of unlinked members of a family, rows with their blocks.

M follows from the threshold. The chance to miss a pair right at it is that of
sharing under two collections (5.3e-4 for 14 collections at a similarity of
0.85, 3.9e-4 for 20 at 0.8) and that of agreeing in fewer than the required
minhashes (3.4e-4 at 0.85, 2.2e-4 at 0.8); it falls fast above. Components need one
path only, so a missed pair rarely splits one.

Words: A-Z lowered, runs of other characters than \\x20 and \\x09-\\x0D. A set holds 64-bit hashes of shingles.
Defined results: fewer words than a shingle make one shingle of all of them; no
words, an empty or a null text make an empty set, which is linked with nothing.
Rows with a null doc_id take part; a component's id is its smallest doc_id that
is not null (null if there is none) and a null doc_id is never kept, unless its
component has no id, then always. Repeated rows are rows of their own. Only
doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.components import connected
from driftkeep.llm.shared import bounded, discard, free_name, lean, map_pandas, numbered, scanned, stash
from driftkeep.llm.tables import table
from driftkeep.llm.words import batch_words, mix, shingles

R = 4
#: The chance that a pair at the threshold shares under two collections, and that it agrees in too few minhashes, at most.
MISS, CUT_MISS = 6e-4, 5e-4
#: Members of a bucket that meet in one task; a larger bucket goes block against block.
BUCKET = 20_000
#: Members and shingles of a block of a family.
BLOCK, BLOCK_SHINGLES = 2_000, 2_000_000
#: Bytes of bit sets that a tile may take; with more, sets are intersected one by one.
BITS = 1 << 26
SIGNED = "row long, doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def collections(percent: int) -> int:
    """How many collections keep the chance to share under two at the threshold within MISS: 14 at least and even, for whole signature words."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    p, m = (percent / 100) ** R, 14
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > MISS:
        m += 2
    return m


def least_equal(percent: int, n: int) -> int:
    """The largest number of n minhashes that a pair at the threshold reaches but for a chance of CUT_MISS."""
    s, c, below = percent / 100, 0, 0.0
    while c < n and (below := below + comb(n, c) * s**c * (1 - s) ** (n - c)) <= CUT_MISS:
        c += 1
    return c


def _sketch(width: int, m: int):
    salts = mix(np.arange(1, m * R + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = ((t if isinstance(t, str) else "").encode("utf-8", "replace") for t in pdf.text)
            at = 0
            for n, h, off in batch_words(texts):
                v, o = shingles(h, off, width)
                size = np.diff(o)
                some = np.flatnonzero(size > 0)
                sig = np.zeros((n, m * R), np.uint32)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(some):
                    first = o[:-1][some]
                    for k, salt in enumerate(salts):
                        x = v * salt
                        x ^= x >> np.uint64(29)
                        x *= np.uint64(0xBF58476D1CE4E5B9)
                        sig[some, k] = (np.minimum.reduceat(x, first) >> np.uint64(32)).astype(np.uint32)
                    d1[some] = np.add.reduceat(mix(v + np.uint64(11)), first)
                    d2[some] = np.add.reduceat(mix(v ^ np.uint64(0x5555555555555555)), first)
                part = slice(at, at + n)
                yield pd.DataFrame({"row": pdf.row.to_numpy()[part], "doc_id": pdf.doc_id.to_numpy()[part], "n_shingles": size, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "sig": [s.tobytes() for s in sig]})
                at += n

    return run


def _collected(m: int):
    """A hash for each collection of each representative, which the collection's number is part of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                sig = np.frombuffer(b"".join(part.sig), np.uint32).reshape(-1, m, R).astype(np.uint64)
                u = np.tile(mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)), (len(part), 1))
                for r in range(R):
                    u = mix(u * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r] + np.uint64(1))
                yield pd.DataFrame({"part": u.view(np.int64).ravel(), "rep": np.repeat(part.rep.to_numpy(), m)})

    return run


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose value of a column others have as well, with their number n."""
    return rows.join(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name)


def _members(reps: DataFrame, m: int) -> DataFrame:
    """key, rep, n: the buckets of n > 1 representatives (rep, sig), one for each pair of collections that these share.

    Whoever shares a pair of collections shares both, so keys are made of the
    collections that another representative has: most texts have none.
    """
    found = _repeated(reps.select("rep", "sig").mapInPandas(lean(_collected(m)), "part long, rep long"), "part")
    own = found.groupBy("rep").agg(F.sort_array(F.collect_list("part")).alias("parts")).filter("size(parts) > 1")
    pairs = F.expr("flatten(transform(parts, (x, i) -> transform(slice(parts, i + 2, size(parts)), y -> xxhash64(x, y))))")
    keys = stash(own.select("rep", F.explode(pairs).alias("key")), "minhash-keys")
    members = stash(_repeated(keys, "key"), "minhash-members")
    discard(keys)
    return members


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each row of 64-bit words are zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    t = (x & low) + low
    t |= x
    t |= low
    return np.bitwise_count(~t).sum(1)


def _sums_to(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sums are at most ``most``, one item at least."""
    ends, at = np.cumsum(total), 0
    while at < len(total):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def _alike(x: np.ndarray, y: np.ndarray, words: np.ndarray, size: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """Which of the pairs (x, y) can be linked by their set sizes and minhashes."""
    at = np.flatnonzero(np.minimum(size[x], size[y]) >= ratio * np.maximum(size[x], size[y]))
    ok = np.zeros(len(x), bool)
    ok[at] = _equal_bytes(words[x[at]] ^ words[y[at]]) >= least
    return ok


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, low)
        while (up := root[root]).sum() != root.sum():
            root = up


def _wide_part(members: np.ndarray, left: int, words: np.ndarray, size: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """Pairs that span the connected parts of a wide bucket: those reached are compared with those not yet reached only.

    With ``left`` under all members the first ``left`` meet the others only.
    """
    found: list[np.ndarray] = []
    open_ = np.ones(len(members), bool)
    for first in range(len(members)):
        if not open_[first]:
            continue
        open_[first] = False
        front = np.array([first])
        while len(front):
            now, front = front[:64], front[64:]
            rest = np.flatnonzero(open_)
            for a in range(0, len(rest), 16_000):
                part = rest[a : a + 16_000]
                x, y = np.repeat(now, len(part)), np.tile(part, len(now))
                if left < len(members):
                    across = (x < left) != (y < left)
                    x, y = x[across], y[across]
                ok = _alike(members[x], members[y], words, size, least, ratio)
                x, y = x[ok], y[ok]
                y, one = np.unique(y, return_index=True)
                open_[y] = False
                found.append(np.stack([members[x[one]], members[y]], 1))
                front = np.concatenate([front, y])
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _parts(least: int, ratio: float):
    """a, b: a tree over each connected part of the buckets of a partition, whose rows come sorted by key, tile, right and rep."""

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, tile, right, rep = pdf.key.to_numpy(), pdf.tile.to_numpy(), pdf.right.to_numpy(), pdf.rep.to_numpy()
        words = np.frombuffer(b"".join(pdf.sig), np.uint64).reshape(len(pdf), -1)
        size = pdf.n_shingles.to_numpy()
        head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (tile[1:] != tile[:-1])]))
        count = np.diff(np.append(head, len(keys)))
        # In a tile of two blocks the right block's rows meet the left block's only.
        left = np.where(right[head] == 2, count, np.add.reduceat((right == 0).astype(np.int64), head))
        pairs = [_wide_part(np.arange(head[i], head[i] + count[i]), int(left[i]), words, size, least, ratio) for i in np.flatnonzero(count > 256)]
        small = count <= 256
        before = np.where(right == 2, np.arange(len(keys)) - np.repeat(head, count), np.where(right == 1, np.repeat(left, count), 0))
        before[~np.repeat(small, count)] = 0
        start = np.repeat(head, count)
        for lo, hi in _sums_to(before, 1_000_000):
            n = before[lo:hi]
            x = np.repeat(np.arange(lo, hi), n)
            y = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(len(x))
            ok = _alike(x, y, words, size, least, ratio)
            pairs.append(np.stack([y[ok], x[ok]], 1))
        both = np.concatenate(pairs)
        root = _roots(len(keys), both[:, 0], both[:, 1])
        child = np.flatnonzero(root != np.arange(len(keys)))
        tree = np.unique(np.stack([rep[root[child]], rep[child]], 1), axis=0)
        yield pd.DataFrame({"a": tree[:, 0], "b": tree[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf.key == pdf.key.iloc[-1]) & (pdf.tile == pdf.tile.iloc[-1])
            cut = int(np.argmax(last.to_numpy()))
            if cut:
                yield from work(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return run


def _tiled(members: DataFrame, blocks: str, wide: str = "0") -> DataFrame:
    """tile and right for members that go block against block; ``blocks`` and ``wide`` are SQL for numbers of blocks of a member's group.

    A member is in the tiles of its block with every block, but not in those of
    two of the last ``wide`` blocks, which the column main deals it to. right is
    2 where all rows of a tile meet each other, else 0 or 1 for its two blocks.
    """
    df = members.withColumn("__n", F.expr(f"cast({blocks} as int)")).withColumn("__w", F.expr(f"cast({wide} as int)"))
    main = "main" if "main" in members.columns else "false"
    rest = "(__n - __w)"
    df = df.withColumn("__g", F.expr(f"cast(if({main}, {rest} + pmod(xxhash64(rep), greatest(__w, 1)), pmod(xxhash64(rep), greatest({rest}, 1))) as int)"))
    df = df.withColumn("__h", F.explode(F.expr(f"if({main}, if({rest} = 0, array(), sequence(0, {rest} - 1)), sequence(0, __n - 1))")))
    tile = F.expr("cast(least(__g, __h) as long) * __n + greatest(__g, __h)")
    right = F.expr("case when __g = __h then 2 when __g > __h then 1 else 0 end")
    return df.withColumn("tile", tile).withColumn("right", right).drop("__n", "__w", "__g", "__h")


class Tile:
    """Members of a tile: sorted shingle hashes, minhash bytes and components, which links join."""

    def __init__(self, sets: list[np.ndarray], words: np.ndarray, comp: np.ndarray):
        self.sets, self.words = sets, words
        self.size = np.array([len(x) for x in sets], np.int64)
        self.lab = np.unique(comp, return_inverse=True)[1]
        self.bits: np.ndarray | None = None

    def _bit_sets(self) -> np.ndarray:
        """A bit for each shingle that two members have at least; no columns where these would be over BITS bytes."""
        ids, df = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)[1:]
        column = np.cumsum(df > 1) - 1
        width = (int((df > 1).sum()) + 63) // 64 * 64
        if len(self.sets) * width // 8 > BITS:
            return np.empty((len(self.sets), 0), np.uint64)
        row = np.repeat(np.arange(len(self.sets)), self.size)
        shared = df[ids] > 1
        flat = np.zeros((len(self.sets), width // 8), np.uint8)
        for a in range(0, len(self.sets), 256):
            part = shared & (row >= a) & (row < a + 256)
            dense = np.zeros((min(256, len(self.sets) - a), width), np.uint8)
            dense[row[part] - a, column[ids[part]]] = 1
            flat[a : a + 256] = np.packbits(dense, axis=1)
        return flat.view(np.uint64) if width else np.zeros((len(self.sets), 1), np.uint64)

    def linked(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        if self.bits is None:
            self.bits = self._bit_sets()
        if self.bits.shape[1]:
            step = max(1, (1 << 22) // self.bits.shape[1])
            both = np.concatenate([np.bitwise_count(self.bits[x[a : a + step]] & self.bits[y[a : a + step]]).sum(1, dtype=np.int64) for a in range(0, len(x), step)])
        else:
            both = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
        return 100 * both >= percent * (self.size[x] + self.size[y] - both)

    def links(self, left: int, least: int, percent: int) -> list[tuple[int, int]]:
        """A tree of links over what links join, besides the given components; with ``left`` under all the first ``left`` meet the others only."""
        n, out = len(self.sets), []
        across = left < n
        lo, step = 0, 1
        while lo < (left if across else n - 1):
            hi = min(lo + step, left if across else n - 1)
            step = min(64, 2 * step)
            x = np.repeat(np.arange(lo, hi), n - (left if across else lo + 1))
            y = np.tile(np.arange(left if across else lo + 1, n), hi - lo)
            lo = hi
            ok = (self.lab[x] != self.lab[y]) & (x < y)
            x, y = x[ok], y[ok]
            ok = _alike(x, y, self.words, self.size, least, percent / 100)
            x, y = x[ok], y[ok]
            # Pairs are checked in growing parts, as every link spares the pairs it joins.
            while len(x):
                part = slice(0, max(1024, n))
                ok = self.linked(x[part], y[part], percent)
                for i, j in zip(x[part][ok].tolist(), y[part][ok].tolist(), strict=True):
                    if self.lab[i] != self.lab[j]:
                        out.append((i, j))
                        self.lab[self.lab == self.lab[j]] = self.lab[i]
                x, y = x[part.stop :], y[part.stop :]
                ok = self.lab[x] != self.lab[y]
                x, y = x[ok], y[ok]
        return out


def _sets(texts: pd.Series, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, h, off in batch_words((t if isinstance(t, str) else "").encode("utf-8", "replace") for t in texts):
        v, o = shingles(h, off, width)
        out += [v[o[i] : o[i + 1]].copy() for i in range(len(o) - 1)]
    return out


def _exact(width: int, percent: int, least: int):
    """a, b: a tree of the links of the tiles of a partition, whose rows come sorted by family, tile and right."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple[int, int] | None = None
        held: list[tuple] = []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                right, rep, comp, sig, sets = zip(*held, strict=True)
                words = np.frombuffer(b"".join(sig), np.uint64).reshape(len(held), -1)
                left = len(held) if right[0] == 2 else right.count(0)
                found.extend((rep[i], rep[j]) for i, j in Tile(list(sets), words, np.array(comp)).links(left, least, percent))
            held.clear()

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                rows = zip(part.family.tolist(), part.tile.tolist(), part.right.tolist(), part.rep.tolist(), part.comp.tolist(), part.sig, _sets(part.text, width), strict=True)
                for family, tile, *row in rows:
                    if (family, tile) != key:
                        close()
                        key = family, tile
                    held.append(tuple(row))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
                found.clear()
        close()
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _exact_links(rows: DataFrame, bodies: DataFrame, width: int, percent: int, agree: int, name: str) -> DataFrame:
    """Trees of links of tiled members (family, tile, right, rep, comp)."""
    tiles = bodies.join(bounded(rows.select("family", "tile", "right", "rep", "comp"), 250_000), "rep").select("family", "tile", "right", "rep", "comp", "sig", "text")
    dealt = tiles.repartition("family", "tile").sortWithinPartitions("family", "tile", "right", "rep")
    return stash(dealt.mapInPandas(lean(_exact(width, percent, agree)), "a long, b long"), name)


def _joined(families: DataFrame, links: DataFrame) -> DataFrame:
    """family, rep, weight and comp, the smallest member of its component under the links."""
    roots = connected(families.select(F.col("rep").alias("node")), links).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    return families.drop("comp").join(roots, "rep")


def _links(families: DataFrame, bodies: DataFrame, width: int, percent: int, agree: int) -> DataFrame:
    """Trees of links that join all components of the families (family, rep, weight)."""
    blocks = f"greatest(ceil(count(1) / {BLOCK}), ceil(sum(weight) / {BLOCK_SHINGLES}))"
    sized = lambda df: df.groupBy("family").agg(F.expr(blocks).cast("int").alias("blocks"))
    dealt = families.join(sized(families), "family").withColumn("comp", F.col("rep"))
    one = dealt.withColumn("tile", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("right", F.lit(2))
    links = _exact_links(one, bodies, width, percent, agree, "minhash-links")
    wide = dealt.filter("blocks > 1").select("family", "rep", "weight")
    if wide.isEmpty():
        return links
    wide = stash(wide, "minhash-wide")
    near = stash(_joined(wide, links.join(wide.select(F.col("rep").alias("a")), "a", "left_semi")), "minhash-wide-comp")
    heads = near.filter("rep = comp").join(sized(near.filter("rep = comp")), "family")
    tiles = heads.withColumn("tile", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("right", F.lit(2))
    more = _exact_links(tiles, bodies, width, percent, agree, "minhash-links")
    links = links.unionByName(more)
    near = stash(_joined(wide, near.select(F.col("comp").alias("a"), F.col("rep").alias("b")).unionByName(more)), "minhash-wide-comp")
    sizes = near.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("family").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("most")).filter("comps > 1").select("family", "most")
    apart = near.join(largest, "family").withColumn("main", F.expr("comp = most")).drop("most")
    n = apart.groupBy("family", "main").agg(F.expr(blocks).cast("int").alias("k")).groupBy("family").agg(F.sum("k").alias("blocks"), F.max(F.when(F.col("main"), F.col("k"))).alias("wide"))
    tiles = _tiled(apart.join(n, "family"), "blocks", "wide")
    return links.unionByName(_exact_links(tiles, bodies, width, percent, agree, "minhash-links"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row and first_row.

    row numbers the input's rows as ``numbered`` does and first_row is the
    smallest of the component. Documents are linked if 100 * intersection >=
    percent * union of their sets of ``width``-word shingles.
    """
    ratio, m = percent / 100, collections(percent)
    agree = least_equal(percent, m * R)
    texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    signed = stash(map_pandas(texts.select("row", "doc_id", "text"), _sketch(width, m), SIGNED, ("doc_id",)), "minhash-sig")
    classes = stash(signed.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "minhash-classes")
    reps = stash(signed.select(F.col("row").alias("rep"), "sig", "n_shingles").join(classes.select("rep"), "rep", "left_semi"), "minhash-reps")
    members = _members(reps, m)
    short = reps.select("rep", "n_shingles", F.expr(f"cast(concat({', '.join(f'substring(sig, {4 * k + 1}, 1)' for k in range(m * R))}) as binary)").alias("sig"))
    buckets = _tiled(members, f"ceil(n / {BUCKET})").join(short, "rep").select("key", "tile", "right", "rep", "n_shingles", "sig")
    raw = buckets.repartition("key", "tile").sortWithinPartitions("key", "tile", "right", "rep").mapInPandas(lean(_parts(agree, ratio)), "a long, b long")
    tree = stash(raw.distinct(), "minhash-tree")
    discard(members)
    nodes = tree.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    families = connected(nodes, tree).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    families = stash(families.join(short.select("rep", F.col("n_shingles").cast("long").alias("weight")), "rep"), "minhash-families")
    bodies = texts.select(F.col("row").alias("rep"), "text").join(bounded(families.select("rep")), "rep", "left_semi").join(short.select("rep", "sig"), "rep")
    links = _links(families, stash(bodies, "minhash-texts"), width, percent, agree)
    comp = connected(classes.select(F.col("rep").alias("node")), links).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    named = stash(classes.join(comp, "rep"), "minhash-named")
    found = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("n_shingles", "d1", "d2", "component_id", "comp", F.lit(True).alias("found"))
    out = signed.join(found, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "row", F.coalesce("comp", "row").alias("first_row")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component, all columns."""
    docs = scanned(docs)
    name = free_name("row", docs)
    rows = numbered(docs, name)
    gone = stash(near_duplicates(docs.select("doc_id", "text"), width, percent).filter("row <> first_row").select(F.col("row").alias(name)), "minhash-gone")
    return rows.join(bounded(gone), name, "left_anti").drop(name)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
