"""Vectorised tokenising and hashing of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's id is a
64-bit polynomial hash over random per-byte values, taken from one running sum
over the buffer, so no Python object is made per word.  Two different words
share an id with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed together; bounds the working arrays (about 40 bytes a byte).
CHUNK = 250_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_BYTE[65:91] = _BYTE[97:123]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK + 1), U(base))
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ U(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of consecutive documents, in order, and the number of words of each."""
    base, n = int(offsets[0]), len(offsets) - 1
    buf = data[base : int(offsets[-1])]
    if not len(buf):
        return np.zeros(0, U), np.zeros(n, np.int64)
    bounds = offsets - base
    space = _SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)  # a document begins here
    cut[bounds] = True
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= space[1:] | cut[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    total = np.cumsum(_BYTE[buf] * powers(_P, len(buf)))
    h = total[last] - np.where(first > 0, total[first - 1], U(0))
    h *= powers(_PINV, len(buf))[first]
    return mix(h), np.diff(np.searchsorted(first, bounds))


def word_batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, word ids, words per document) for each chunk of the column."""
    data, offsets = string_buffers(column)
    for i, j in chunks(offsets):
        ids, counts = words(data, offsets[i : j + 1])
        yield i, ids, counts


def token_hash(text: str) -> np.ndarray:
    """Word ids of one text."""
    return next(word_batches(pa.array([text])))[1] if text else np.zeros(0, U)


_MUL = [int(x) | 1 for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """Ids of the n-word shingles of one document; of a shorter one, that of the whole sequence."""
    if not len(ids):
        return ids
    k = min(n, len(ids))
    h = np.full(len(ids) - k + 1, U(k))
    for j in range(k):
        h = h + ids[j : len(ids) - k + 1 + j] * U(_MUL[j])
    return mix(h)
