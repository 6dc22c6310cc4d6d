"""Whole texts as Arrow buffers: words and shingles as 64-bit hashes, without a Python object per word.

Words are runs of word bytes after A-Z are lower-cased.  Every character outside ASCII is a run of bytes
>= 0x80 in UTF-8, so a byte table expresses each of the word rules used here exactly.  Hashes are Karp-Rabin
polynomials modulo 2**64, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays (about 40 bytes for each byte of text).
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a : b + 1] = True
    return t


#: Everything but white space: [^\x20\x09-\x0D]+
SPACED = ~_table((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once lower-cased
ALNUM = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEP = 1024


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base & _MASK
    return out


_POW = _powers(_BASE, _STEP)
_SHINGLE = _powers(0xD6E8FEB86659FD93, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """An avalanche step on unsigned 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], data


def chunks(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK bytes, or of one longer text."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(offs: np.ndarray, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first word of each row and one past the last) of the words."""
    low = _LOWER[data]
    is_word = table[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    begin = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
    value = low[pos + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    if (longest := int(size.max())) <= _STEP:
        value *= _POW[pos]
    else:  # exact powers for words of any length
        value *= _POW[pos % _STEP] * _powers(pow(_BASE, _STEP, 1 << 64), longest // _STEP + 1)[pos // _STEP]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def words(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: (its first row, word hashes, index of the first word of each row and one past the last)."""
    offs, data = buffers(column)
    for a, b in chunks(offs):
        part = offs[a : b + 1] - offs[a]
        low, starts, ends, at = word_spans(part, data[offs[a] : offs[b]], table)
        yield a, word_hashes(low, starts, ends), at


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every k consecutive words (k <= 64); those across two rows are for the caller to skip."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _SHINGLE[0]
    for i in range(1, k):
        out = out + h[i : i + n] * _SHINGLE[i]
    return mix(out + np.uint64(k))


def shingle_sets(column: pa.Array, table: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words."""
    for _, h, at in words(column, table):
        grams = rolling(h, k)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if j - i >= k:
                g = np.sort(grams[i : j - k + 1])
                keep = np.empty(len(g), bool)
                keep[:1] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield g[keep]
            elif j > i:
                yield rolling(h[i:j], j - i)
            else:
                yield np.zeros(0, np.uint64)
