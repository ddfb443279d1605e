"""Vectorised word, n-gram and window hashes over Arrow string columns.

Everything here works on the bytes of many documents at once with numpy; no Python loop runs over
characters or words. Hashes are 64 bits, deterministic across processes and machines, and depend
only on the words themselves. Null texts behave as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multipliers: bytes within a word, words within a sequence.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
#: Bytes of text handled in one vectorised step (a longer document is a step of its own).
STEP_BYTES = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII characters other than letters and digits.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_PLAIN = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))
_FOLDED = _PLAIN.copy()
_FOLDED[0x41:0x5B] = _PLAIN[0x61:0x7B]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=U))
        if size > 4 * STEP_BYTES:  # a rare giant: do not keep its tables
            return pair[0], pair[1]
        _POWERS[base] = have = (pair[0], pair[1])
    return have


class Words:
    """The words of some documents: ``hash`` per word, ``first`` word of each document (n + 1 entries), byte ``start`` and ``end``."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.hash, self.first, self.start, self.end = hashes, first, start, end


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and its offsets into them; nulls are empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows that hold about ``limit`` bytes."""
    raw, offsets = bytes_of(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(raw: np.ndarray, offsets: np.ndarray, fold: bool, blank: np.ndarray = SPACE) -> Words:
    """Words between ASCII white space, or other ``blank`` bytes; ``fold`` lower-cases A-Z only."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, U), np.zeros(len(offsets), np.int64), z, z)
    word = ~blank[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, inverse = powers(_BYTE_BASE, n + 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((_FOLDED if fold else _PLAIN)[raw] * p[:n], dtype=U, out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s])
    return Words(h, np.searchsorted(s, offsets), s, e)


def word_heads(raw: np.ndarray, w: Words, n: int, fold: bool) -> np.ndarray:
    """Hash of the first n bytes of each word, in the space of word hashes."""
    if not len(w.start):
        return np.zeros(0, U)
    p, inverse = powers(_BYTE_BASE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((_FOLDED if fold else _PLAIN)[raw] * p[: len(raw)], dtype=U, out=total[1:])
    return mix((total[np.minimum(w.start + n, w.end)] - total[w.start]) * inverse[w.start])


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any run of words."""
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * powers(_WORD_BASE, len(h) + 1)[0][: len(h)], dtype=U, out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1, equal for equal word sequences wherever they stand."""
    inverse = powers(_WORD_BASE, len(total))[1]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its lower-cased ``size``-word shingles (fewer words: one of all)."""
    w = split_words(raw, offsets, fold=True)
    total = prefix_sums(w.hash)
    first = w.first
    starts = np.arange(max(0, len(w.hash) - size + 1))
    grams = span_hash(total, starts, starts + size) if len(starts) else np.zeros(0, U)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield span_hash(total, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, U)
