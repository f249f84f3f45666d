"""The training-data operators on small fixtures: brute force, nulls, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftkeep.llm import bpe, components, decontaminate, exact_topk, feistel_pii, kdtree_sharding, line_dedup, minhash_dedup, suffix_dedup, toxicity, warc
from driftkeep.llm.shared import numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    base, shared = prose(300), prose(90)
    texts = [prose(RNG.randint(1, 200)) for _ in range(25)] + [base] * 3 + [base + " " + prose(4 + 9 * i) for i in range(6)] + [prose(40) + " " + shared + " " + prose(30) for _ in range(3)]
    texts += [None, "", "   \n", "one two", "ONE two", "x" * 1500, "né " * 300, shared + shared]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 7, "k") for i, t in enumerate(texts)] + [(None, base, None, None, None, None, None), (3, texts[3], "en", "s1", 1, 7, "k")]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_shards(corpus, nothing):
    df, rows = corpus
    got = kdtree_sharding.kd_shards(df, n_shards=6).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    weight, slots = Counter(), {}
    for r in got:
        weight[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(weight) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(weight.values()) - min(weight.values()) <= 2 * max(r.size for r in got)
    assert kdtree_sharding.kd_shards(nothing, n_shards=4).count() == 0
    one = max(kdtree_sharding.kd_shards(df, target_bytes=10**9).collect(), key=lambda r: r.shard)
    assert one.shard == 0


def test_shards_are_a_tree_of_weighted_medians(spark):
    """Every node of the tree, found anew from its rows: halves are apart along its widest dimension, and cut where the weight says."""
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([5, 50, 500, rng.randint(0, 3000)]), f"http://host.example/{rng.choice('abc')}/{rng.randint(0, 999):03}", rng.choice([None, rng.random()])) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double").repartition(4)
    dims = ("bytes", "source", "quality")
    meta = kdtree_sharding.coordinates(kdtree_sharding.metadata(df, list(dims)), 3).collect()
    urls = sorted({s for _, _, s, _ in rows})
    top = kdtree_sharding.CRC_BITS + kdtree_sharding.ROW_BITS
    source = {i: s for i, _, s, _ in rows}
    assert all(abs((r["__k1"] >> top) - urls.index(source[r.doc_id]) * ((1 << 20) - 1) // (len(urls) - 1)) <= 1 for r in meta)
    got = {r.doc_id: r.shard for r in kdtree_sharding.kd_shards(df, n_shards=11, dims=dims).collect()}
    keys = {r.doc_id: (r["size"], [r[f"__k{i}"] for i in range(3)]) for r in meta}

    def check(docs, first, shards):
        assert {got[d] for d in docs} <= set(range(first, first + shards))
        if shards == 1:
            return
        spans = [max(keys[d][1][i] >> top for d in docs) - min(keys[d][1][i] >> top for d in docs) for i in range(3)]
        dim, half = spans.index(max(spans)), shards // 2
        left, right = [d for d in docs if got[d] < first + half], [d for d in docs if got[d] >= first + half]
        assert max(keys[d][1][dim] for d in left) < min(keys[d][1][dim] for d in right)
        weight = lambda ds: sum(keys[d][0] for d in ds)
        assert abs(weight(left) - weight(docs) * half / shards) <= max(keys[d][0] for d in docs)
        check(left, first, half)
        check(right, first + half, shards - half)

    check(list(keys), 0, 11)


def test_shards_cut_a_third_of_equal_rows(spark):
    df = spark.createDataFrame([(5, "same text")] * 100 + [(i, f"text {i:04}") for i in range(200)], "doc_id long, text string")
    n = Counter(r.shard for r in kdtree_sharding.kd_shards(df, n_shards=10).collect())
    assert max(n.values()) <= 34 and len(n) == 10


def test_bpe_rows(corpus, nothing):
    df, rows = corpus
    got = bpe.digests(bpe.encode(df)).collect()
    assert len(got) == len(rows) and bpe.encode(nothing).count() == 0
    empty = next(r for r in got if r.doc_id == next(i for i, t, *_ in rows if t is None and i is not None))
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest() == empty.decoded_sha256
    both = bpe.encode(df).select("doc_id", "decoded").exceptAll(bpe.decode(bpe.encode(df)))
    assert both.count() == 0


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        m = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        m = np.cumsum(m)[: len(d)] > 0
        out.append((len(d), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), np.frombuffer(d, np.uint8)[~m].tobytes()))
    return out


def rows_exchanged(spark, after=-1):
    """Rows that stages after the given one wrote to shuffles, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() > after), max((x.stageId() for x in stages), default=-1)


@pytest.mark.parametrize("group", [600, 2])
def test_repeated_bytes(corpus, nothing, monkeypatch, group):
    df, rows = corpus
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows]), strict=True))
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_crowded_spans_are_not_exchanged_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 20)
    rng = random.Random(14)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = some(620), []
    for i in range(90):  # the passage whole, cut at either end, with a byte changed, and too short to be a repeat
        cut = passage[rng.randint(0, 150) : 620 - rng.randint(0, 150)] if i % 3 else passage
        cut = cut[:300] + "#" + cut[301:] if i % 10 == 0 else cut[:380] if i % 10 == 1 else cut
        texts.append(some(rng.randint(0, 300)) + cut + some(rng.randint(0, 300)))
    rows = list(enumerate(texts))
    df, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows_exchanged(spark)[1]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert rows_exchanged(spark, before)[0] < 12_000
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute_repeats(texts), strict=True))


def test_periodic_and_very_long_texts(spark):
    own = "".join(RNG.choice("abcdefgh ") for _ in range((1 << 20) + 700))
    rows = [(0, "=" * 3000), (1, "abc" * 700 + "x" + "abc" * 300), (2, own), (3, "q" + own[1_048_000:1_048_900] + "q"), (4, "ab" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = df.withColumn("row", F.col("doc_id")).mapInPandas(suffix_dedup._find, suffix_dedup.ANCHORS)
    assert found.filter("row < 2").count() < 200  # of 5,203 windows
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for (i, t), b in zip(rows[:2] + rows[4:], brute_repeats([t for _, t in rows[:2] + rows[4:]]), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == b
    assert (got[2].n_removed, got[3].n_removed, bytes(got[3].kept)) == (900, 900, b"qq")


def brute_classes(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(corpus, nothing, width, percent):
    df, rows = corpus
    got = minhash_dedup.near_duplicates(df, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def edited(words, share, rng):
    return " ".join(f"{rng.getrandbits(24):x}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("bucket,block", [(20_000, 2_000), (40, 25)])
def test_large_groups_against_brute_force(spark, monkeypatch, bucket, block):
    # BUCKET and BLOCK are part of the plan, which the driver makes, so small ones hold on workers too.
    monkeypatch.setattr(minhash_dedup, "BUCKET", bucket)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng, rows = random.Random(8), []
    for share, n in ((0.012, 150), (0.028, 150), (0.05, 100)):  # linked, around the threshold, under it
        words = [f"{rng.getrandbits(24):x}" for _ in range(200)]
        rows += [(len(rows) + i, edited(words, share, rng)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, 3, 85).collect())
    want = brute_classes(rows, 3, 85)
    assert len({c for _, _, c in want}) > 150 and sum((want - got).values()) <= 2  # the stated chance to miss a link


def test_texts_unlike_all_others_make_no_bucket_keys(spark):
    rng = random.Random(12)
    words = [f"{rng.getrandbits(32):x}" for _ in range(80)]
    rows = [(i, " ".join(f"{rng.getrandbits(32):x}" for _ in range(80))) for i in range(500)] + [(500 + i, " ".join(words + ["x"] * i)) for i in range(2)]
    df, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows_exchanged(spark)[1]
    assert {r.doc_id for r in minhash_dedup.near_duplicates(df, 5, 80).collect() if not r.kept} == {501}
    assert rows_exchanged(spark, before)[0] < 502 * 100  # 190 pairs of collections


def test_buckets_are_those_of_all_pairs_of_collections(spark):
    rng = random.Random(13)
    sig = [np.array([rng.randint(0, 2) for _ in range(14 * minhash_dedup.R)], np.uint32) for _ in range(120)]
    reps = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "rep long, sig binary")
    want = {}
    for i, x in enumerate(sig):
        parts = [(k, *x[4 * k : 4 * k + 4].tolist()) for k in range(14)]
        for a in range(14):
            for b in range(a + 1, 14):
                want.setdefault((parts[a], parts[b]), []).append(i)
    got = {}
    for r in minhash_dedup._members(reps, 14).collect():
        got.setdefault((r.key, r.n), []).append(r.rep)
    assert all(n == len(x) for (_, n), x in got.items())
    assert Counter(tuple(sorted(x)) for x in got.values()) == Counter(tuple(x) for x in want.values() if len(x) > 1) and len(got) > 100


@pytest.mark.parametrize("left", [40, 15])
def test_tiles_against_brute_force(left):
    rng = random.Random(9)
    words = [f"{rng.getrandbits(24):x}" for _ in range(120)]
    texts = pd.Series([edited(words, 0.03, rng) for _ in range(40)])
    sets = minhash_dedup._sets(texts, 3)
    same = np.zeros((40, 7), np.uint64)
    links = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) and (left == 40 or i < left <= j)}
    for bits in (1 << 26, 1):
        minhash_dedup.BITS, old = bits, minhash_dedup.BITS
        tree = minhash_dedup.Tile(list(sets), same, np.arange(40)).links(left, 0, 80)
        minhash_dedup.BITS = old
        roots = lambda e: minhash_dedup._roots(40, *np.array(sorted(e), np.int64).reshape(-1, 2).T).tolist()
        assert set(tree) <= links and roots(tree) == roots(links) and len(tree) == 40 - len(set(roots(links)))
    size = np.full(40, 9)
    sig = np.array([[rng.getrandbits(8) if rng.random() < 0.1 else 7 for _ in range(56)] for _ in range(40)], np.uint8).view(np.uint64)
    x, y = np.triu_indices(40, 1)
    ok = minhash_dedup._alike(x, y, sig, size, 46, 0.85) & ((left == 40) | ((x < left) & (y >= left)))
    assert roots(list(zip(x[ok], y[ok]))) == roots(minhash_dedup._wide_part(np.arange(40), left, sig, size, 46, 0.85).tolist())


def test_pairs_at_the_threshold_are_rarely_missed(spark):
    rng, rows = random.Random(4), []
    for i in range(3000):
        own = [f"{rng.getrandbits(32):x}" for _ in range(104)]
        rows += [(2 * i, " ".join(own[:94])), (2 * i + 1, " ".join(own[:84] + own[94:]))]  # 80 of 100 shingles
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert got.filter("component_id % 2 = 1").count() <= 8


def test_one_of_each_class_stays(corpus):
    df, rows = corpus
    left = minhash_dedup.keep_first(df, 3, 85)
    assert left.columns == df.columns
    n_empty = sum(not (t or "").strip() for _, t, *_ in rows)
    classes = minhash_dedup.near_duplicates(df, 3, 85)
    assert left.count() == classes.filter("n_shingles > 0").select("first_row").distinct().count() + n_empty


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50)], "a long, b long")
    got = {r.node: r.root for r in components.connected(spark.range(60).withColumnRenamed("id", "node"), edges).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i == 51 else i for i in range(60)}


def fewest_substitutions(masks, n_max):
    """For n aligned tokens up to n_max the fewest substitutions that leave no mask a hit: a walk over the last tokens' agreement."""
    span = max(map(len, masks))
    kinds, best, out = [(len(m), int(m, 2)) for m in masks], {0: 0}, [0]
    for n in range(1, n_max + 1):
        after = {}
        for last, cost in best.items():
            for same in (0, 1):
                w = (last << 1 | same) & ((1 << span) - 1)
                if not any(n >= size and w & m == m for size, m in kinds):
                    k = w & ((1 << span - 1) - 1)
                    after[k] = min(after.get(k, 10**6), cost + 1 - same)
        best = after
        out.append(min(best.values()))
    return out


def test_seeds_find_all_that_the_rule_accepts():
    allowed = lambda n: n - int(np.ceil(decontaminate.IDENTITY * n - 1e-9))
    long, short = fewest_substitutions(decontaminate.MASKS, 300), fewest_substitutions(decontaminate.SHORT_MASKS, 12)
    assert all(long[n] > allowed(n) for n in range(decontaminate.MIN_TOKENS, 301))
    assert all(short[n] > allowed(n) for n in range(decontaminate.SPAN, 13))


def brute_leaks(docs, items):
    out, words = {}, lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    for i, d in docs:
        for j, t in items:
            x, y = words(d), words(t)
            need = decontaminate.needed(len(y))
            for diagonal in range(-len(y) + 1, len(x)) if y else ():
                same = [x[p + diagonal] == w if 0 <= p + diagonal < len(x) else None for p, w in enumerate(y)]
                for at in range(len(y) - need + 1):
                    run = same[at : at + need]
                    if None not in run and sum(run) >= (decontaminate.IDENTITY * need if len(y) >= decontaminate.SPAN else need):
                        out[i, j] = max(out.get((i, j), (0, 0, 0)), (sum(run), need, len(y)))
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 900])
def test_leaks(spark, limit):
    rng = random.Random(6)
    items = [(j, prose(n)) for j, n in enumerate([3, 5, 6, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 20, 26, 29, 30, 30, 36, 41, 50])] + [(90, None), (91, "")]
    docs = [(100 + i, prose(rng.randint(0, 60))) for i in range(20)] + [(200, None), (201, ""), (202, items[14][1].upper() + "!"), (203, prose(1500) + " " + items[20][1])]
    for i in range(160):
        words = items[i % 21][1].split()
        for at in rng.sample(range(len(words)), min(len(words), rng.choice([0, 1, len(words) // 6, len(words) // 5, len(words) // 4]))):
            words[at] = f"x{rng.getrandbits(20)}"
        cut = rng.choice([0, 0, len(words) // 3])
        docs.append((1000 + i, " ".join([prose(rng.randint(0, 9)), *words[cut:], prose(rng.randint(0, 9))])))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 60 and set(map(tuple, decontaminate.contaminated_pairs(df, bench, limit).collect())) == want
    both = df.unionByName(df.filter("doc_id = 202").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(df.filter("doc_id = 202"))
    got = set(map(tuple, decontaminate.contaminated_pairs(both, bench, limit).collect()))
    assert got == want | {(None, *x[1:]) for x in want if x[0] == 202}
    assert decontaminate.contaminated_pairs(df.limit(0), bench, limit).count() == 0
    assert decontaminate.contaminated_pairs(df, bench.limit(0), limit).count() == 0
    clash = both.withColumnsRenamed({"item_id": "bad"})
    assert {r.doc_id for r in decontaminate.drop_contaminated(clash, bench).collect()} == {i for i, _ in docs} - {x[0] for x in want} | {None}


def test_toxicity(spark, nothing):
    bad = lambda: prose(30) + " grumok " + prose(5) + " velzan " + prose(10)
    rows = [(i, bad() if i % 4 == 0 else prose(50), 9.0) for i in range(400)] + [(None, None, 1.0), (1000, "", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    lexicon, model = toxicity.train(df, labels)
    got = toxicity.score(df, lexicon, model)
    assert got.columns == ["doc_id", "text", "toxicity", "toxicity_"]
    held = [r for r in got.collect() if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.toxicity_ >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95
    none = toxicity.train(df, labels.limit(0))
    assert {round(r.toxicity_, 3) for r in toxicity.score(df, *none).collect()} == {0.0}
    assert toxicity.score(nothing, lexicon, model).count() == 0


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 10, "<p>a</p>", "z" * 50_000]
    rows = [(i, f"http://h/{i}", h, "x") for i, h in enumerate(html)] + [(5, "http://h/5", "<p>a</p>", "x"), (None, None, "<p>a</p>", "x"), (None, None, "lone", "x")]
    index = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect())
    want = Counter()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        top = max((j for j, _, x, _ in rows if (x or "").encode() == p and j is not None), default=None)
        first = top is None or i == top
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else top] += 1
    assert got == want
    entry = index.filter("page_id = 4").first()
    assert warc.read_record(entry)[1].endswith("é".encode())
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("lines", [line_dedup.BROADCAST_LINES, 0])
def test_lines(spark, nothing, monkeypatch, lines):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", lines)
    rows = [(i, f"menu\n{prose(5)}\n\nfoot  ", "a", 3) for i in range(12)] + [(20, "menu\nmenu", "b", 3), (21, None, "a", 3), (22, "menu", "a", 3), (23, "menu", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, 0.5, 10).collect()}
    assert got[0].text.count("\n") == 1 and "menu" not in got[0].text and got[0]["n_lines_"] == 4 and got[0].n_dropped == 2
    assert got[20].text == "menu\nmenu" and got[21].text is None and got[22].text == "" and got[23].text == "menu"
    assert line_dedup.dedup_lines(nothing).count() == 0
    clash = df.withColumnsRenamed({"n_lines": "__drop"}).withColumn("__host", F.lit(1)).withColumn("__kept", F.lit(2))
    out = line_dedup.dedup_lines(clash, 0.5, 10, once=True)
    assert set(clash.columns) < set(out.columns) and {r.doc_id: r.text for r in out.collect()} == {i: r.text for i, r in got.items()}
    long = spark.createDataFrame([(i, "menu\n" + f"own {i} " * 200_000, "a") for i in range(10)], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(long, 0.5, 10).collect()} == {i: f"own {i} " * 200_000 for i in range(10)}


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist(), 1) for i in range(120)] + [(200, [1e30] * 6, 1), (250, [float("nan")] * 6, 1), (300, None, 1), (350, [1.0, None] + [0.0] * 4, 1), (None, [1.0] * 6, 1), (50, rng.normal(size=6).astype(np.float32).tolist(), 1)]
    rows += [(400 + i, rows[0][1], 1) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) if abs(x) < 1e20 else (256 * int(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    small = [(i, v) for i, v in ok if max(map(abs, v)) < 1 << 40]
    got = Counter(map(tuple, exact_topk.exact_topk(df.filter("vec_id is null or vec_id <> 200")).collect()))
    want = Counter()
    for a, (i, v) in enumerate(small):
        if i is not None and i % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j if j is not None else 0, j) for b, (j, w) in enumerate(small) if a != b)[:5]
            want.update((i, r + 1, x[3], -x[0]) for r, x in enumerate(s))
    assert got == want
    huge = [r for r in exact_topk.exact_topk(df).collect() if r.query_id == 200]
    assert len(huge) == 5 and all(abs(r.score) <= 1 << 63 for r in huge)
    assert exact_topk.exact_topk(df.limit(0)).count() == 0


def test_pseudonyms(spark, nothing):
    text = "c 4041894974608795 4041-8949-7460-8795 4041894974608796 +1 (988) 555-2485 1.2.3.4 300.1.1.1 a.b1@x.org 123-45-6789 2024-02-29 2023-02-30 GB82WEST12345698765432"
    df = spark.createDataFrame([(0, text, 1), (1, text, 1), (2, None, 1), (3, "", 1), (4, "plain", 1)], "doc_id long, text string, n_pseudonyms int")
    got = {r.doc_id: r for r in feistel_pii.pseudonymize(df, "k1").collect()}
    a = got[0].text
    assert a == got[1].text and got[0].n_pseudonyms_ == 8 and got[2].text is None and got[3].text == "" and got[4].text == "plain"
    assert "4041894974608795" not in a and "4041894974608796" in a and "300.1.1.1" in a and "2023-02-30" in a and "123-45-6789" not in a
    cards = re.findall(r"c (\d{16}) ([\d-]{19})", a)[0]
    assert cards[0] == cards[1].replace("-", "") and [len(x) for x in cards[1].split("-")] == [4] * 4
    luhn = [int(c) for c in cards[0]][::-1]
    assert (sum(luhn[0::2]) + sum(d * 2 - 9 * (d > 4) for d in luhn[1::2])) % 10 == 0
    iban = a.split()[-1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert feistel_pii.pseudonymize(df, "other").filter("doc_id = 0").first().text != a
    assert feistel_pii.pseudonymize(nothing, "k1").count() == 0


def test_numbers_beside_others(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = [
        (f"{card} 12/25", [card]), ("4041894974608795 123", ["4041894974608795"]), ("7 4041894974608795", ["4041894974608795"]), (f"1234 5678 {card}", [card]), (f"{card} 4041894974608795 9", [card, "4041894974608795"]),
        (f"{iban} ABC", [iban]), (f"{iban} 12", [iban]), (f"AB12 {iban}", [iban]), (f"{iban} {card}", [iban, card]), (f"AB12 {card}", [card]),
        (f"{card} 7 123-45-6789", [card, "123-45-6789"]), (f"{card} 10.0.0.1", [card, "10.0.0.1"]), (f"{card} 12/25/2024", [card, "12/25/2024"]), (f"{card} 12.b@x.org", [card, "12.b@"]), (f"{iban} 988 555-2485", [iban, "988 555-2485"]),
    ]
    same = ["1 " * 9000, "12" * 9000, "AA11" * 9000, "4111 1111 1111 1112 12", "x-4111111111111111", "4111111111111111-x", "AB12 WORD WORD WORD ABC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for t, _ in texts] + same)], "doc_id long, text string")
    got = {r.doc_id: r for r in feistel_pii.pseudonymize(df, "k1").collect()}
    for i, (t, values) in enumerate(texts):
        assert got[i].n_pseudonyms == len(values) and not any(v in got[i].text for v in values), (t, got[i].text)
    for i, t in enumerate(same[1:], len(texts) + 1):
        assert got[i].text == t and got[i].n_pseudonyms == 0


def one_to_one(texts):
    """Texts, pseudonyms and restored texts that differ from the first, as counts; and the pseudonyms."""
    out = feistel_pii.restore(feistel_pii.pseudonymize(texts.withColumn("was", F.col("text")), "k1").withColumn("made", F.col("text")), "k1")
    out = out.select("was", "made", "text").persist()
    got = out.agg(F.countDistinct("was"), F.countDistinct("made"), F.sum((F.col("text") != F.col("was")).cast("long")), F.min(F.length("made") == F.length("was"))).first()
    moved = out.filter("made <> was").count()
    out.unpersist()
    return tuple(got), moved


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(36525 + 36524).select(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = [days.select(F.date_format("d", f).alias("text")) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy")]
    forms.append(days.filter("day(d) > 12").select(F.date_format("d", "dd/MM/yyyy").alias("text")))
    texts = forms[0]
    for f in forms[1:]:
        texts = texts.unionByName(f)
    n = texts.count()
    (was, made, wrong, same), moved = one_to_one(texts)
    assert (was, made, wrong, same) == (n, n, 0, True) and moved > 0.999 * n


@pytest.mark.parametrize("kind", ["ssn", "ipv4", "phone", "card", "email", "iban"])
def test_kinds_are_permuted_one_to_one(spark, kind):
    rng, n = random.Random(3), 3000
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = "411111" + digits(9)
        s = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(int(c) for c in reversed(body)))
        return body + str(-s % 10)

    def iban():
        bban = "WEST" + digits(14)
        return f"GB{98 - int(''.join(str(int(c, 36)) for c in bban + 'GB00')) % 97:02}{bban}"

    make = {
        "ssn": lambda: f"{rng.choice([*range(1, 666), *range(667, 900)]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}", "ipv4": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "phone": lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", "card": card, "email": lambda: f"{rng.choice('abcXYZ')}{digits(2)}.q{digits(1)}@x.org", "iban": iban,
    }[kind]
    texts = sorted({make() for _ in range(n)})
    (was, made, wrong, _), moved = one_to_one(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert (was, made, wrong) == (len(texts), len(texts), 0) and moved > 0.98 * len(texts)


def test_the_key_is_in_no_plan(spark):
    df = feistel_pii.pseudonymize(spark.createDataFrame([(1, "4041894974608795")], "doc_id long, text string"), "some-secret-key")
    df.collect()
    assert "some-secret-key" not in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        feistel_pii.pseudonymize(df, "")


def test_large_ids_beside_nulls(spark):
    """Ids above 2**53 stay exact though null ids stand in the same batch."""
    big = [(1 << 60) + 1, (1 << 60) + 3, None]
    text = prose(120)
    df = spark.createDataFrame([(i, text, text, "en", "s", [1.0, 2.0]) for i in big], "doc_id long, text string, html string, lang string, source string, embedding array<float>").coalesce(1)
    bench = spark.createDataFrame([((1 << 61) + 1, text), (None, prose(20))], "item_id long, text string")
    ids = lambda out, c="doc_id": {r[c] for r in out.select(c).collect()}
    assert ids(minhash_dedup.near_duplicates(df)) == ids(bpe.encode(df)) == ids(bpe.decode(bpe.encode(df))) == ids(suffix_dedup.remove_repeats(df)) == set(big)
    assert ids(minhash_dedup.near_duplicates(df), "component_id") == {big[0]}
    assert ids(decontaminate.contaminated_pairs(df, bench)) == set(big) and ids(decontaminate.contaminated_pairs(df, bench), "item_id") == {(1 << 61) + 1}
    assert ids(toxicity.score(df, *toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int")))) == set(big)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "html")
    read = warc.read_bundles(warc.write_bundles(pages))
    assert ids(read, "page_id") == set(big) and ids(read, "refers_to") == {big[1], None}
    top = exact_topk.exact_topk(df.select(F.col("doc_id").alias("vec_id"), "embedding").unionByName(spark.createDataFrame([(1 << 60) // 50 * 50], "long").select(F.col("value").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))))
    assert [r.vec_id for r in top.orderBy("rank").collect()] == big


def test_numbers_stay_when_splits_change(spark, tmp_path):
    spark.range(0, 20_000, 1, 5).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text")).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d").filter("doc_id % 3 <> 0")
    rows, old = numbered(df), spark.conf.get("spark.sql.files.maxPartitionBytes")
    first = {r.doc_id: r.row for r in rows.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    again = numbered(df.select("doc_id"))
    assert again.rdd.getNumPartitions() > 20 and {r.doc_id: r.row for r in again.collect()} == first == {r.doc_id: r.row for r in rows.select("doc_id", "row").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(set(first.values())) == len(first) == df.count()
    assert numbered(df.withColumn("__path", F.lit(1)).unionByName(df.withColumn("__path", F.lit(2)))).select("row").distinct().count() == 2 * len(first)


def test_texts_longer_than_a_piece(spark):
    item = prose(40)
    long = prose(240_000)
    texts = [long + " 4041894974608795 " + item, prose(20), long + " grumok velzan " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert min(len(texts[0]), len(texts[2])) > 1 << 20
    got = {r.doc_id: r for r in feistel_pii.pseudonymize(df, "k1").collect()}
    assert got[0].n_pseudonyms == 1 and got[0].text[: len(long)] == long and "4041894974608795" not in got[0].text and got[1].text == texts[1]
    assert {r.doc_id: r["size"] for r in kdtree_sharding.kd_shards(df, n_shards=2).collect()} == {i: len(t) + 16 for i, t in enumerate(texts)}
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.n_matched) for r in decontaminate.contaminated_pairs(df, bench).collect()] == [(0, 20)]
    rows = [(10 + i, prose(30) + (" grumok velzan" if i % 2 else "")) for i in range(200)]
    learned = spark.createDataFrame(rows, "doc_id long, text string").unionByName(df)
    model = toxicity.train(learned, spark.createDataFrame([(i, int(i % 2 == 1)) for i, _ in rows], "doc_id long, toxic int"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(df, *model).collect()}
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores.values()) and scores[1] < 0.5
