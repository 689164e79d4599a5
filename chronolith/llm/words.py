"""Vectorised hashing of words and word shingles straight from Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z are
lower-cased.  Every byte is mapped to a random 64-bit value, a prefix sum of
value * BASE**position gives each word's polynomial hash modulo 2**64, and a
final mix spreads it.  No Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 17  # text bytes hashed at a time; a longer document is cut at white space

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SHINGLE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work whose memory is many times that of the texts."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; ``x`` is left alone."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES * 2, 1 << (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def _hash_piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in ``data``; ``cuts`` are positions where a word must not run on."""
    n = len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = cuts[cuts < n]
    begins[inner] = solid[inner]
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = solid
    ends[1:n] &= ~solid[1:]
    cut_ends = cuts[(cuts > 0) & (cuts <= n)]
    ends[cut_ends] = solid[cut_ends - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = power_tables(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), start


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words of each row) for successive row ranges of a string column; null has no words."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    valid = np.asarray(column.is_valid())
    first = 0
    while first < len(column):
        last = first + 1
        while last < len(column) and offsets[last + 1] - offsets[first] <= BLOCK_BYTES:
            last += 1
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi - lo <= 2 * BLOCK_BYTES:
            h, start = _hash_piece(data[lo:hi], offsets[first : last + 1] - lo)
            row = np.searchsorted(offsets[first + 1 : last + 1] - lo, start, side="right")
            keep = valid[first:last][row]
            if not keep.all():
                h, row = h[keep], row[keep]
            yield first, last, h, np.bincount(row, minlength=last - first)
        else:  # one long document: pieces that end at white space
            parts, at = [], lo
            while at < hi and valid[first]:
                to = min(hi, at + BLOCK_BYTES)
                while to < hi:
                    back = np.flatnonzero(_SPACE[data[max(at, to - 4096) : to]])
                    if len(back):
                        to = max(at, to - 4096) + int(back[-1]) + 1
                        break
                    to = min(hi, to + 4096)
                parts.append(_hash_piece(data[at:to], np.zeros(0, dtype=np.int64))[0])
                at = to
            h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            yield first, last, h, np.array([len(h)])
        first = last


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, one for each place where a whole run starts; fewer words make one run of all."""
    if len(words) == 0:
        return words
    if len(words) < k:
        return mix((words * _SHINGLE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _U(len(words)))
    n = len(words) - k + 1
    total = words[:n] * _SHINGLE[0]
    for i in range(1, k):
        total += words[i : i + n] * _SHINGLE[i]
    return mix(total + _U(k))


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted distinct shingle hashes, word hashes) for every row of a string column."""
    for first, last, h, counts in word_hashes(column):
        ends = np.cumsum(counts)
        run = shingle_hashes(h, k) if len(h) >= k else np.zeros(0, dtype=np.uint64)
        for r in range(last - first):
            e, n = int(ends[r]), int(counts[r])
            s = run[e - n : e - k + 1] if n >= k else shingle_hashes(h[e - n : e], k)
            s = np.sort(s)
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield first + r, s, h[e - n : e]
