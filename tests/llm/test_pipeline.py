"""The pipeline's stages on odd tables, and its whole run against plain versions of the stages."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from driftkeep.llm import minhash_dedup
from driftkeep.llm.shared import lean, stash
from driftkeep.llm.tables import table

DIR = "/root/testdata/sf0.001"
#: Enough labels to learn from.
LARGER = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_lines(rows, ratio=0.01, least=10):
    """doc_id, text, source without lines of over a hundredth of the source's distinct texts."""
    pages = {(s, t or "") for _, t, s in rows}
    total = Counter(s for s, _ in pages)
    held = Counter((s, x) for s, t in pages for x in {x.strip(" ") for x in t.split("\n")} if x)
    bad = {k for k, n in held.items() if n >= least and total[k[0]] >= least and n > ratio * total[k[0]]}
    cut = lambda t, s: t if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad)
    return [(i, cut(t, s), s) for i, t, s in rows]


def plain_classes(rows, width=5, percent=80):
    """Sets of row numbers that links join."""
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    classes = {}
    for a in range(len(rows)):
        classes.setdefault(find(a), []).append(a)
    return list(classes.values())


def plain_leaks(rows, items):
    """Rows in which a run of half of an item's tokens, 13 at least, agrees to four fifths."""
    split = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bad = set()
    for n, (_, t, _) in enumerate(rows):
        x = split(t)
        at = {}
        for p, w in enumerate(x):
            at.setdefault(w, []).append(p)
        for item in items:
            y = split(item)
            need = len(y) if len(y) < 13 else max(13, -(-len(y) // 2))
            least = 0.8 * need if len(y) >= 6 else need
            for d in {p - q for q, w in enumerate(y) for p in at.get(w, ())}:
                lo, hi = max(0, -d), min(len(y), len(x) - d)
                same = [x[q + d] == y[q] for q in range(lo, hi)]
                if any(sum(same[a : a + need]) >= least for a in range(len(same) - need + 1)):
                    bad.add(n)
    return bad


def test_the_whole_run_against_plain_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    docs = table(spark, LARGER, "documents")
    clean = [tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, LARGER).select("doc_id", "text", "source").orderBy("doc_id").collect()]
    toxic = {r.doc_id for r in table(spark, LARGER, "labels").filter("toxic = 1").collect()}
    # Some 160 labels, of which a tenth are toxic, teach most of it.
    assert 0.7 * len(toxic) <= len(toxic - {i for i, _, _ in clean})
    lines = plain_lines(clean)
    kept = [min(c) for c in plain_classes(lines)]
    kept += [n for c in plain_classes(lines) for n in c if not words(lines[n][1]) and n not in kept]
    left = [lines[n] for n in sorted(set(kept))]
    bad = plain_leaks(left, [r.text for r in table(spark, LARGER, "benchmark").collect()])
    left = [r for n, r in enumerate(left) if n not in bad]
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = Counter()
    for i, t, _ in left:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), tok.decode(ids, skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded) for r in corpus_pipeline.run(spark, LARGER).collect())
    assert 0 < len(bad) and len(kept) < len(lines) and got == want


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names the stages use themselves."""
    given = table(spark, DIR, "documents").limit(60)
    names = ["row", "__row", "bad", "toxicity", "n_lines", "__host", "__drop", "__kept", "__page_row", "item_id", "component_id"]
    extra = given.withColumns({n: F.lit(i).cast("long") for i, n in enumerate(names)}).withColumn("nested", F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b")))
    kind = extra.schema
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in kind.fields])
    none = [None] * len(kind.fields)
    row = lambda i, t: tuple([i, t, "en", "host"] + none[4:])
    long = " ".join(f"w{i}" for i in range(200_000)) + "\nend"
    more = spark.createDataFrame([tuple(none), tuple(none), row(900, ""), row(901, " \n\t "), row(902, long), row(903, long), row(904, "two words"), row(904, "two words"), row(None, "two words")], nullable)
    return extra.unionByName(more)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, name, stage):
    out = stash(stage(spark, odd, DIR), "test")
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.dtypes == odd.dtypes and out.filter("nested.a = 1").select("nested.b").distinct().count() == 1
    n, ids = out.count(), {r.doc_id for r in out.select("doc_id").collect()}
    assert {900, 901, 902, 904, None} <= ids | ({None} if name == "minhash near-dedup" else set())
    if name in ("line dedup", "bpe encoding and decoding"):
        assert n == odd.count()
    if name == "minhash near-dedup":
        # One of the long texts and one of the pairs of words stay; texts without words are linked with nothing.
        assert 903 not in ids and out.filter("text = 'two words'").count() == 1 and out.filter("text is null").count() == 2
    assert stage(spark, odd.limit(0), DIR).count() == 0


def test_the_whole_run_on_odd_and_empty_tables(spark, odd, tmp_path):
    for n in ("labels", "benchmark"):
        table(spark, DIR, n).write.parquet(f"{tmp_path}/a/{n}.parquet")
        table(spark, DIR, n).limit(0).write.parquet(f"{tmp_path}/b/{n}.parquet")
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert {900, 902} <= {r.doc_id for r in got.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_one_of_each_class_is_left(spark):
    docs = table(spark, DIR, "documents")
    left = stash(corpus_pipeline.drop_near_duplicates(spark, docs, DIR), "test")
    assert minhash_dedup.near_duplicates(left, 5, 80).filter("n_shingles > 0 and row <> first_row").count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, "one page\nand its copies", "a") for i in range(12)] + [(100 + i, f"menu\nown line {i}", "a") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, df, DIR).collect()}
    assert got == {i: f"own line {i - 100}" if i >= 100 else t for i, t, _ in rows}


def test_workers_hand_freed_memory_back():
    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) >> 10

    def run(batches):
        for _ in batches:
            # Blocks too small for maps of their own, and one at the end that keeps the heap from shrinking by itself.
            parts = [b"x" * (60_000 + i) for i in range(4000)]
            last.append(b"y" * 60_000)
            del parts
            yield held()

    last = []
    assert list(lean(run)(iter([0])))[0] - held() > 150
