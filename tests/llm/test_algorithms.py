"""The algorithms of the training-data operators against brute force, without Spark."""

import io
import itertools
import random
import struct

import numpy as np
import pytest
import zstandard

from driftkeep.llm import boosted, bpe, decontaminate, suffix_dedup, toxicity, warc, words

ODD = ["", "   ", "aaaaaaa bbbbb'll it's 'S I'D", "<|endoftext|>", "x <|startoftext|>y <|end", "ΑΣ ΟΔΟΣ", "ﬁ ½ ² 三 ٣", "\x1c\x1f a b\x85c\xa0d\x00e", "½\x1c b", "😀👍🏽 x", "İI ı ŉ'n", "a" * 3000, "abab" * 300, "ß ẞ é É"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib, ours = Tokenizer.from_file(path), bpe.tokenizer(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdeÉ'1 .,!") for _ in range(80)) for _ in range(60)]
    for text, (ids, shown) in zip(texts, ours.batch(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert shown == lib.decode(want, skip_special_tokens=False) == ours.decode(ids)


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(1)
    for _ in range(150):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 13))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(1, 4)
        got = {texts[o[0][0]][o[0][1] : o[0][1] + n]: sorted(o) for n, o in suffix_dedup.repeat_groups(texts, least=least)}
        where = {}
        for i, s in enumerate(texts):
            for a in range(len(s)):
                for n in range(least, len(s) - a + 1):
                    where.setdefault(s[a : a + n], []).append((i, a))
        def maximal(w, o):
            left = {texts[i][a - 1] if a else (i, "<") for i, a in o}
            right = {texts[i][a + len(w)] if a + len(w) < len(texts[i]) else (i, ">") for i, a in o}
            return len(o) > 1 and len(left) > 1 and len(right) > 1
        assert got == {w: sorted(o) for w, o in where.items() if maximal(w, o)}


def test_masks_tolerate_substitutions():
    def hit(length, bad):
        return any(all(c == "0" or i + j not in bad for j, c in enumerate(m)) for m in decontaminate.MASKS for i in range(length - len(m) + 1))
    for length, subs in ((13, 2), (16, 3)):
        assert all(hit(length, set(b)) for b in itertools.combinations(range(length), subs))


def test_word_hashes_follow_words():
    rng = random.Random(4)
    texts = [b"", b" \t", b"One two", "Ünï ONE".encode()] + [bytes(rng.choice(b"abC \n") for _ in range(50)) for _ in range(40)]
    seen = {}
    for n, h, off in words.batch_words(texts):
        for i in range(n):
            got, want = h[off[i] : off[i + 1]].tolist(), texts[i].lower().split() if texts[i].isascii() else [b"\xc3\x9cn\xc3\xaf", b"one"]
            assert len(got) == len(want)
            for x, w in zip(got, want, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_text_equals_its_pieces(monkeypatch):
    data = b" ".join(b"w%d" % (i % 97) for i in range(5000))
    whole = words.doc_words(data)[0]
    monkeypatch.setattr(words, "PIECE", 1000)
    assert (words.doc_words(data)[0] == whole).all()


@pytest.mark.parametrize("width", [3, 5])
def test_shingles_are_distinct_sets(width):
    texts = [b"a b c d a b c d a b", b"a", b"", b"a b", b"b a"]
    n, h, off = next(iter(words.batch_words(texts)))
    v, o = words.shingles(h, off, width)
    sizes = np.diff(o).tolist()
    want = [len({tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) if len(w) >= width else min(len(w), 1) for w in (t.split() for t in texts)]
    assert sizes == want and v[o[3]] != v[o[4]]


def test_isotonic_rises_and_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int)
    m = boosted.fit(x[:400], y[:400], np.arange(400) % 4 == 0)
    s = m.score(x[400:])
    assert ((s >= 0.5) == y[400:]).mean() > 0.85 and s.min() >= 0 and s.max() <= 1
    knots, levels = boosted.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


def test_features_see_veiled_words():
    f = toxicity.Features({"vequ*": 3.0})
    assert len(f.of("")) == toxicity.N_FEATURES
    assert f.of("you 1d1ot")[16] > 0 and f.of("vequtas bon")[4] == 1.0


def test_seek_table_and_records(tmp_path):
    b = warc.Bundle(str(tmp_path / "x.warc.zst"))
    at = [b.add(warc.record(f"urn:page:{i}", "http://a/ b", b"p" * i, "D", None if i % 2 else "urn:page:9", "1970-01-01T00:00:00Z")) for i in range(30)]
    b.close()
    raw = (tmp_path / "x.warc.zst").read_bytes()
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE
    f = io.BytesIO(raw)
    starts, sizes = warc.seek_table(f)
    for i, (frame, offset) in enumerate(at):
        head, block, _ = warc.parse(warc.read_frame(f, starts[frame], sizes[frame]), offset)
        assert head["WARC-Record-ID"] == f"<urn:page:{i}>" and len(block) == len(warc.HTTP_HEAD) + (i if i % 2 else 0)
    # Frames and the skippable table are one stream that any reader takes.
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read().startswith(b"WARC/1.1")
