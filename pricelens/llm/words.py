"""Words, n-grams and shingles of whole text batches as 64-bit hashes, without a loop over words.

A word is a run of ASCII letters and digits and of bytes beyond ASCII; everything else separates.
Callers lower the case in Spark, which knows all alphabets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about this many bytes, so working memory stays flat.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    up = np.full(n + 1, _BASE, dtype=np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) of consecutive texts of about ``BLOCK_BYTES`` in all.

    A single longer text is a block of its own, whole.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        span = offsets[first : end + 1]
        yield first, end, data[span[0] : span[-1]], span - span[0]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a block, and where each text's words begin (one more than texts)."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    np.take(_WORD_BYTE, data, out=inside[:n])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text boundary between two word bytes starts a new word and ends the one before.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(np.concatenate([inside[:-1] & (~inside[1:] | begins[1:]), [False]])) + 1
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def joined(hashes: np.ndarray, firsts: np.ndarray, steps: tuple[int, ...]) -> tuple:
    """Hashes of the words at ``i + step`` for all steps, where one text has them all.

    Returns the hashes and where each text's begin.
    """
    reach = steps[-1]
    counts = np.maximum(np.diff(firsts) - reach, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) + np.repeat(firsts[:-1] - begins[:-1], counts)
    whole = np.full(len(at), len(steps) * 0x51_7C_C1 + reach, dtype=np.uint64)
    for step in steps:
        whole = mix(whole * np.uint64(_BASE) + hashes[at + step])
    return whole, begins


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``words`` words; a shorter text that has words is one shingle."""
    hashes, firsts = word_hashes(data, offsets)
    counts = np.diff(firsts)
    whole, begins = joined(hashes, firsts, tuple(range(words)))
    short = np.flatnonzero((counts > 0) & (counts < words))
    if not len(short):
        return whole, begins
    extra = np.zeros(len(short), dtype=np.uint64)
    for step in range(words - 1):
        has = counts[short] > step
        extra[has] = mix(extra[has] * np.uint64(_BASE) + hashes[firsts[short[has]] + step])
    sizes = np.diff(begins)
    whole = np.insert(whole, begins[short], extra)
    sizes[short] = 1
    return whole, np.concatenate([[0], np.cumsum(sizes)])
