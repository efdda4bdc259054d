"""Vectorised words and word hashes over the UTF-8 bytes of an Arrow string column.

Texts are never turned into Python strings here.  A slice of a batch is one array of
bytes with the documents' offsets; words are runs of bytes of a class, found by table
lookup, and a word's hash comes from prefix sums of a polynomial modulo 2**64, so the
cost per byte does not depend on the length of words or documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 18
SLICE_DOCS = 1000
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U64)


#: A random number for each byte; A-Z have those of a-z, so hashes ignore ASCII case.
BYTE_CODE = _splitmix(256, 20)
BYTE_CODE[65:91] = BYTE_CODE[97:123]

_powers: dict[str, np.ndarray] = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}


def _grown(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _BASE if which == "pow" else _BASE_INV, dtype=U64)
        base[0] = 1
        _powers[which] = np.cumprod(base, dtype=U64)
    return _powers[which]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def utf8_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, docs: int = SLICE_DOCS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes.

    A longer text is a run of its own: texts are never cut.
    """
    raw, at = utf8_arrays(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + docs, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (byte positions), and words before each document."""
    inside = is_word[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal but for the case of A-Z: equal hashes."""
    m = len(raw)
    sums = np.zeros(m + 1, U64)
    np.cumsum(BYTE_CODE[raw] * _grown("pow", m)[:m], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _grown("inv", m + 1)[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(_STEP)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, the words' hashes in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(_STEP) + h[j : j + n]
    return mix(out + U64(k))


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(total)
