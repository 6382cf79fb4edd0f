"""Hashes of words and word sequences, over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_RANDOM = np.random.default_rng(77003)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalize 64-bit sums, so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from random values of its bytes and places.

    Words beyond 4096 bytes reuse the places, shifted by how often, so that all their bytes count. A megabyte of words,
    or one that is longer, is hashed at a time.
    """
    out = np.empty(len(starts), np.uint64)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK_BYTES)), len(starts)))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lengths = ends[a:b] - starts[a:b]
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        value = _BYTE[data[np.repeat(starts[a:b], lengths) + place]]
        far = np.flatnonzero(place >= len(_PLACE))
        if len(far):
            value[far] = mixed(value[far] + (place[far] // len(_PLACE)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            place %= len(_PLACE)
        out[a:b] = mixed(np.add.reduceat(value * _PLACE[place], firsts) + lengths.astype(np.uint64))
    return out


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of length words, from the hashes of the words."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, length * 0xD1B54A32D192ED03 % (1 << 64), np.uint64)
    for j in range(length):
        total += words[j : j + n] * _PLACE[j]
    return mixed(total)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte."""
    lo = size = 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_BYTES:
            yield lo, at + 1
            lo, size = at + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def block_words(texts: list[bytes], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: its first text, begins of texts and their first words, and starts, ends and hashes of words."""
    for lo, hi in blocks(texts):
        data = np.frombuffer(b" ".join(texts[lo:hi]), np.uint8)
        if lower:
            data = _LOWER[data]
        starts, ends = word_bounds(data)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts[lo:hi])])
        yield lo, begins, np.searchsorted(starts, begins), starts, ends, word_hashes(data, starts, ends)


def each_text(texts: list[bytes], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, hashes) of the words of each text; starts and ends count from the text's own start."""
    for _, begins, at, starts, ends, hashes in block_words(texts, lower):
        for k in range(len(begins) - 1):
            a, b = at[k], at[k + 1]
            yield starts[a:b] - begins[k], ends[a:b] - begins[k], hashes[a:b]


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted. Fewer words than length are one shingle; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(sequence_hashes(words, min(length, len(words))))
