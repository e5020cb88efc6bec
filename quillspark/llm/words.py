"""Words of Arrow string batches as arrays: bounds in the UTF-8 bytes, and 64-bit hashes.

Words are runs of bytes outside U+0020 and U+0009 to U+000D, which UTF-8 never uses within a longer
character. The hash is a polynomial over a random byte table, read off prefix sums, so all words of a
batch are hashed at once; it is then mixed so that all its bits can be used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
#: Multipliers of the positions in a window of words.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _powers = out[0], out[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; one hash of the whole where there are fewer (none: empty)."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    acc = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        acc = acc + words[j : n - k + 1 + j] * _PLACE[j]
    return mix(acc + np.uint64(k))


def _spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, len(texts))
        i = j


def words_of(texts: pa.Array, lower: bool = False, most: int = 1 << 20, breaks: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, bytes, word starts, word ends, hashes, and where each row's words begin).

    ``texts`` has no nulls. ``breaks``: which bytes end a word, where it is not white space alone.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    table = _LOWER if lower else _TABLE
    for i, j in _spans(texts, most):
        b = values[at[i] : at[j]]
        rows = at[i : j + 1] - at[i]
        if not len(b):
            yield i, b, rows[:0], rows[:0], np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        word = ~(_IS_WS if breaks is None else breaks)[b]
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[rows] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(table[b] * up[: len(b)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        yield i, b, starts, ends, hashes, np.searchsorted(starts, rows)
