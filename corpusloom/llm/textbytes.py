"""Vectorised passes over the UTF-8 bytes of Arrow string columns.

Everything here works on blocks of whole rows, so memory follows the block size (or
the longest single text), not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A 64-bit value for each byte, after ASCII lower-casing.
_VALUE = mix(_LOWER.astype(np.uint64) * _U(0xD1342543DE82EF95) + _U(0x2545F4914F6CDD1D))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; nulls count as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a run of bytes other than ASCII white space."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased; equal words, equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inverse = _power_tables(len(data))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * p[: len(data)], dtype=np.uint64)))
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; the whole sequence if shorter; none if empty."""
    for first, end, data, offsets in blocks(column):
        starts, ends, rows = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(end - first + 1))
        m = len(h) - n + 1
        rolled = np.zeros(0, np.uint64)
        if m > 0:
            rolled = np.zeros(m, np.uint64)
            for k in range(n):
                rolled = mix(rolled + h[k : k + m] * _U(2 * k + 0x9E3779B97F4A7C15))
        for r in range(end - first):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= n:
                yield np.unique(rolled[a : b - n + 1])
            elif b > a:
                x = _U(b - a)
                with np.errstate(over="ignore"):
                    acc = np.full(1, x * _U(0xC2B2AE3D27D4EB4F), np.uint64)
                    for k in range(a, b):
                        acc = mix(acc + h[k] * _U(0x165667B19E3779F9))
                yield acc
            else:
                yield np.zeros(0, np.uint64)
