"""Vectorised word hashing over UTF-8 buffers.

A batch of texts becomes one byte buffer; words are found with a lookup table.
A word of up to eight bytes is one 64-bit number, which a bijection hashes, so
the cost is a few array passes instead of a Python object per word; a longer
word is hashed by BLAKE2b, with the recent ones remembered. Pieces of at most
PIECE bytes are worked on at a time, cut at white space, so a very long text
costs memory for its word hashes only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = 0x2545F4914F6CDD1D):
        self._b, self._i = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 4096)
            steps = np.full(size, self._b, np.uint64), np.full(size, self._i, np.uint64)
            for x in steps:
                x[0] = 1
            self.up, self.down = (np.cumprod(x) for x in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()

#: Lower-casing of A-Z alone, other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Word separators \x20 and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: For words of letters, digits and non-ASCII characters, all else separates.
NON_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NON_ALNUM[_lo:_hi] = False


#: The bytes of a little-endian number that a word of 0 to 8 bytes has.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_known: dict[bytes, int] = {}


def _long_word(word: bytes) -> int:
    h = _known.get(word)
    if h is None:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(_known) >= 1 << 17:
                _known.clear()
            _known[word] = h
    return h


def _piece_words(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one buffer."""
    sep = separators[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    low = np.concatenate([ASCII_LOWER[buf], np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(buf) + 1, np.uint64, low, strides=(1,))
    size = end - start
    h = mix((lanes[start] & _FIRST_BYTES[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
    long = np.flatnonzero(size > 8)
    if len(long):
        data = low.tobytes()
        h[long] = [_long_word(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h, start, end


def _pieces(data: bytes, separators: np.ndarray) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            window = np.frombuffer(data, np.uint8, min(1 << 16, len(data) - end), end)
            hit = np.flatnonzero(separators[window])
            if len(hit):
                end += int(hit[0])
                break
            end += len(window)
        yield at, data[at:end]
        at = end


def doc_words(data: bytes, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts and byte ends of one text of any length."""
    if len(data) <= PIECE:
        return _piece_words(np.frombuffer(data, np.uint8), separators)
    parts = []
    for at, piece in _pieces(data, separators):
        h, s, e = _piece_words(np.frombuffer(piece, np.uint8), separators)
        parts.append((h, s + at, e + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def batch_words(texts: Iterable[bytes], separators: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of consecutive texts as (number of texts, word hashes, word offsets of the texts).

    Short texts share a buffer; a text of over PIECE bytes is a group of its own.
    """
    held: list[bytes] = []
    size = 0

    def flush() -> tuple[int, np.ndarray, np.ndarray]:
        lens = np.fromiter((len(x) for x in held), np.int64, len(held))
        h, s, _ = _piece_words(np.frombuffer(b" ".join(held), np.uint8), separators)
        bounds = np.concatenate([[0], np.cumsum(lens + 1)])
        return len(held), h, np.searchsorted(s, bounds)

    for t in texts:
        if held and size + len(t) > PIECE:
            yield flush()
            held, size = [], 0
        if len(t) > PIECE:
            h, _, _ = doc_words(t, separators)
            yield 1, h, np.array([0, len(h)])
            continue
        held.append(t)
        size += len(t) + 1
    if held:
        yield flush()


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and their offsets.

    A text of fewer than ``width`` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    n_docs = len(offsets) - 1
    counts = np.diff(offsets)
    full = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        full = mix(full * _BASE + h[k : k + len(full)] + np.uint64(k + 1))
    n_sh = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(n_sh)])
    pos = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], n_sh)
    short = np.flatnonzero((counts > 0) & (counts < width))
    values = np.zeros(len(pos), np.uint64)
    whole = np.ones(len(pos), bool)
    whole[out[short]] = False
    values[whole] = full[pos[whole]]
    for d in short:
        x = np.zeros(1, np.uint64)
        for w in h[offsets[d] : offsets[d + 1]]:
            x = mix(x * _BASE + w + np.uint64(77))
        values[out[d]] = mix(x + np.uint64(counts[d]))[0]
    doc = np.repeat(np.arange(n_docs), n_sh)
    order = np.lexsort((values, doc))
    values = values[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    kept = np.bincount(doc[first], minlength=n_docs) if n_docs else np.empty(0, np.int64)
    return values[first], np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
