"""Hashes of words and shingles for whole Arrow batches of text.

Words are found and hashed straight in the UTF-8 buffer of a batch, about 256 kB at
a time, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += 32
_FOLDED += 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            grown = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            grown[0] = 1
            _powers[name] = np.multiply.accumulate(grown)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (rows + 1) and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of whole rows: first row, their offsets from 0, their bytes."""
    at, data = text_buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, rows)
        yield first, at[first:last + 1] - at[first], data[at[first]:at[last]]
        first = last


def _edges(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where rows begin (one more than bytes)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    return ~_IS_SPACE[data], edge


def _starts(inside: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))


def word_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Words of every row."""
    return np.diff(np.searchsorted(_starts(*_edges(offsets, data)), offsets))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and where each row's words begin (rows + 1)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside, edge = _edges(offsets, data)
    starts = _starts(inside, edge)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words of one text; a shorter text is one run."""
    n = len(words)
    if not n:
        return words
    width_used = min(width, n)
    out = np.full(n - width_used + 1, width_used, np.uint64)
    factors = mix(np.arange(1, width_used + 1, dtype=np.uint64)) | np.uint64(1)
    for i in range(width_used):
        out += words[i:i + len(out)] * factors[i]
    return mix(out)


def row_shingles(words: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The shingle hashes of every row whose words begin at ``at`` (rows + 1)."""
    every = shingle_hashes(words, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield (every[a:b - width + 1] if b - a >= width
               else shingle_hashes(words[a:b], width))
