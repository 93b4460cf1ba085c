"""Word shingles as 64-bit fingerprints, and fast similarity sketches of their sets.

Works on the bytes of a whole Arrow column at once. Two different shingles of one comparison share a
fingerprint with a probability of about 2^-64 for each pair of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, dtype=U64), np.full(n + 1, _INVERSE, dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def word_prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of every word of a string column, in order."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((_LOWER[raw] + U64(1)) * up[:-1], out=sums[1:], dtype=U64)
    prints = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93))
    return prints, np.searchsorted(offsets, first, side="right") - 1


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' sorted distinct shingle fingerprints, one after another, and where each row's begin.

    A row with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    prints, rows = word_prints(column)
    n = len(column)
    counts = np.bincount(rows, minlength=n)
    begins = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.repeat(counts >= words, sizes)
    at = np.arange(out[-1]) - np.repeat(out[:-1], sizes) + np.repeat(begins[:-1], sizes)
    shingles = np.zeros(out[-1], dtype=U64)
    length = np.where(whole, words, np.repeat(np.minimum(counts, words), sizes))
    for k in range(words):
        use = k < length
        shingles[use] = mix(shingles[use] * U64(0x2545F4914F6CDD1D) + prints[at[use] + k] + U64(k + 1))
    kept, bounds = [], [0]
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        if b - a < 2:
            own = shingles[a:b]
        else:
            own = np.sort(shingles[a:b])
            fresh = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        kept.append(own)
        bounds.append(bounds[-1] + len(own))
    return (np.concatenate(kept) if kept else np.zeros(0, U64)), np.array(bounds, dtype=np.int64)


def sketches(prints: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each set (rows x bins); all ones for an empty set.

    In round i every element is thrown into a random bin with a value in [i, i + 1); a bin keeps its least.
    A set whose bins are all filled at the end of a round is done. After ``bins`` rounds, round
    ``bins + j`` throws all elements into bin j, so that every bin is filled.
    """
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    table = np.full((n, bins), np.iinfo(U64).max, dtype=U64)
    flat = table.reshape(-1)
    open_rows = np.flatnonzero(sizes > 0)
    rows = np.repeat(np.arange(n), sizes)
    for i in range(2 * bins):
        if not len(open_rows):
            break
        if i and len(rows):
            still = np.zeros(n, dtype=bool)
            still[open_rows] = True
            use = still[rows]
            if not use.all():
                prints, rows = prints[use], rows[use]
        hashed = mix(prints + U64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)))
        bin_of = ((hashed >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else np.full(len(rows), i - bins)
        np.minimum.at(flat, rows * bins + bin_of, (U64(i) << U64(48)) | (mix(hashed) >> U64(16)))
        full = (table[open_rows] != np.iinfo(U64).max).all(axis=1)
        open_rows = open_rows[~full]
    return table


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, bins = table.shape
    bands = bins // rows
    keys = np.tile(np.arange(1, bands + 1, dtype=U64) * U64(0xA24BAED4963EE407), (n, 1))
    for k in range(rows):
        keys = mix(keys * U64(0x9FB21C651E98DF25) + table[:, k : bands * rows : rows])
    return keys
