"""BPE encoding and decoding with a pair occurrence index.

Within a batch every distinct word is laid out once in flat arrays. An index
maps each mergeable pair to all of its positions; the lowest active rank is
taken from a heap, all of its occurrences are merged in one array operation,
and only the lists of the pairs next to them are updated. A word therefore
costs its merges once per batch however often it occurs.

Encoding equals the tokenizers library on the given file with
add_special_tokens=False, truncation and padding unused, special-token strings
in a text included; decoding equals decode(ids, skip_special_tokens=False).

Defined results: a null or empty text has no tokens and decodes to "". Texts
are encoded whole. Each input row gives one row, repeated ones included. Only
doc_id and text are read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkeep.llm.shared import map_pandas
from driftkeep.llm.tables import table

#: Bytes of text whose distinct words share one index.
BATCH_BYTES = 2 << 20
_NONE = np.int32(1 << 30)
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Merges of a word-level BPE vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._twin = np.array([a == b for a, b in merges])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words and the offsets of each word. No word may be empty."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lens] = -1
        rank = np.full(n, _NONE, np.int32)
        head = np.flatnonzero(nxt >= 0)
        rank[head] = self.ranks(sym[head], sym[head + 1])
        alive = np.ones(n, bool)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(pos: np.ndarray) -> None:
            r = rank[pos]
            pos = pos[r < _NONE]
            if not len(pos):
                return
            r = rank[pos]
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            heads = [0, *cuts.tolist()]
            for x, a, b in zip(r[heads].tolist(), heads, [*heads[1:], len(r)], strict=True):
                if x in where:
                    where[x].append(pos[a:b])
                else:
                    where[x] = [pos[a:b]]
                    heapq.heappush(active, x)

        note(head)
        while active:
            r = heapq.heappop(active)
            lists = where.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            if self._twin[r] and len(pos) > 1:
                # x x x: from the left, every second of a run of overlapping pairs.
                pos = np.unique(pos)
                joined = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.merged[r]
            alive[gone] = False
            rank[gone] = _NONE
            nxt[pos] = after
            inside = after >= 0
            prv[after[inside]] = pos[inside]
            before = prv[pos]
            touched = np.concatenate([pos, before[before >= 0]])  # a repeat does no harm
            right = nxt[touched]
            has = right >= 0
            rank[touched[~has]] = _NONE
            touched, right = touched[has], right[has]
            rank[touched] = self.ranks(sym[touched], sym[right])
            note(touched)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], kept[np.concatenate([[0], ends])]


class WordTokenizer:
    """The pieces of a tokenizer file: special strings, normalisation, words, merges."""

    #: The file's word pattern, with \\s spelled out for characters under U+0250.
    _WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t\n\x0b\x0c\r \x85\xa0\p{L}\p{N}]+")
    #: Beyond U+0250 the library's tables decide, and for \x1C-\x1F, which split() takes for white space.
    _BEYOND = re.compile("[^\x00-\x1bU-ɏ]".replace("U", " "))

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.bpe = PairIndexBpe(self.vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.strings = {i: s for s, i in {**self.vocab, **self.special}.items()}
        self._path, self._library = path, None
        self._letter_bytes = {c: b for b, c in enumerate(byte_letters())}

    def _far_words(self, text: str) -> list[bytes]:
        """Words by the library's own normaliser and splitter, for characters whose tables may differ."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._letter_bytes[c] for c in w) for w, _ in pieces]

    def words(self, text: str) -> list[str | bytes]:
        """Stretches without white space of a text without special strings: str, or single words in bytes from the library."""
        if self._BEYOND.search(text):
            return self._far_words(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded string of each text."""
        code: defaultdict = defaultdict(count().__next__)
        per_text = []
        for t in texts:
            if self._special and "<|" in t:
                got = []
                for piece in self._special.split(t):
                    got += [(self.special[piece],)] if piece in self.special else self.words(piece)
            else:
                got = self.words(t) if t else []
            per_text.append(np.fromiter(map(code.__getitem__, got), np.int32, len(got)))
        # Each distinct stretch is cut into words once, each distinct word merged once.
        find, word = self._WORD.findall, defaultdict(count().__next__)
        parts = [k if isinstance(k, tuple) else [word[k]] if isinstance(k, bytes) else [word[w] for w in find(k)] for k in code]
        ids, at = self.bpe.encode([w if isinstance(w, bytes) else w.encode() for w in word]) if word else (np.empty(0, np.int32), np.zeros(1, np.int64))
        ids, at = ids.tolist(), at.tolist()
        known = [list(p) if isinstance(p, tuple) else ids[at[p[0]] : at[p[0] + 1]] if len(p) == 1 else [i for w in p for i in ids[at[w] : at[w + 1]]] for p in parts]
        shown = [" ".join([self.strings[i] for i in x]) for x in known]
        size = np.fromiter(map(len, known), np.int64, len(known))
        start = np.cumsum(size) - size
        ids = np.fromiter((i for x in known for i in x), np.int32, int(size.sum()))
        for codes in per_text:
            n = size[codes]
            out = np.cumsum(n)
            total = int(out[-1]) if len(out) else 0
            flat = np.arange(total) + np.repeat(start[codes] - (out - n), n)
            yield ids[flat], " ".join(map(shown.__getitem__, codes.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(map(self.strings.__getitem__, np.asarray(ids).tolist()))


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.text]
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    found = list(tok.batch(texts[at : i + 1]))
                    yield pd.DataFrame({"doc_id": pdf.doc_id.iloc[at : i + 1].to_numpy(), "n_tokens": [len(x) for x, _ in found], "ids": [x.astype("<u4").tobytes() for x, _ in found], "decoded": [s for _, s in found]})
                    at, size = i + 1, 0

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of every row."""
    return map_pandas(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _encoder(path or vocabulary_path()), ENCODED, ("doc_id",))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows that hold ``ids``."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(where)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": [tok.decode(np.frombuffer(x or b"", "<u4")) for x in pdf.ids]})

    return map_pandas(encoded.select("doc_id", "ids"), run, "doc_id long, text string", ("doc_id",))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
