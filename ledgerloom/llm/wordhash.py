"""Hashes of words and of word windows for a whole Arrow batch at once, in NumPy.

A text's UTF-8 bytes are scanned once per batch: every word gets a 64-bit polynomial hash of its bytes and
windows of words get a hash of their words, so nothing here loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32

#: Kinds of word: bytes that end one.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[48:58] = PUNCTUATION[65:91] = PUNCTUATION[97:123] = PUNCTUATION[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch and each text's first byte (with the end appended); null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z as a-z, and the index of each text's first word (with the end appended)."""
    data, first = _text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    stop = breaks[data]
    begins = ~stop
    begins[1:] &= stop[:-1]
    inside = first[:-1][first[:-1] < len(data)]
    begins[inside] = ~stop[inside]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    value = _BYTE[_UPPER[data]]
    value[stop] = 0
    with np.errstate(over="ignore"):
        value *= _powers(_BASE, len(data))
        hashes = mix(np.add.reduceat(value, start) * _powers(_BASE_INVERSE, len(data))[start])
    return hashes, np.searchsorted(start, first)


def window_hashes(words: np.ndarray, slots: list[int]) -> np.ndarray:
    """Hash of the words at offsets ``slots`` from every position that has them all in this array."""
    n = len(words) - max(slots)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in slots:
            out += words[k : k + n] * _SLOT[k % 64]
    return mix(out + np.uint64(len(slots)))


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin.

    A text of fewer than ``size`` words has its whole word sequence as one shingle; one without words none.
    """
    words, first = word_hashes(texts)
    count = np.diff(first)
    grams = window_hashes(words, list(range(size)))
    owner = np.repeat(np.arange(len(count)), count)
    usable = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :]) if len(grams) else np.empty(0, np.int64)
    grams, owner = grams[usable], owner[usable]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.concatenate([window_hashes(words[first[i] : first[i + 1]], list(range(count[i]))) for i in short])
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    edge = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.searchsorted(owner[fresh], np.arange(len(count) + 1))
