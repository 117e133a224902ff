"""Vectorised text kernels shared by the Arrow-batch operators.

All of them work on one contiguous byte buffer holding a bounded chunk of
whole texts, so the per-word cost is a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240601)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and the bytes of other scripts.
IS_PUNCT_OR_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser; overflow wraps by design."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS["up"], _POWERS["down"] = _geometric(_BASE, size), _geometric(_BASE_INV, size)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the polynomial hash of buf[i:j], still scaled by BASE**i."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end], equal for equal bytes."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of whole texts, about ``limit`` bytes each (a longer text comes alone). Null text is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(arr):
        return
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield ids[i:j], whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that Python objects of one slice exist at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batch_chunks(batches, id_col: str, text_col: str, limit: int = CHUNK_BYTES):
    for b in batches:
        yield from chunks(b.column(id_col), b.column(text_col), limit)


def words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = IS_SPACE):
    """Lower-cased bytes, word starts, word ends, and per text the first word's index (len(texts)+1 entries)."""
    low = LOWER[buf]
    inside = ~separators[low]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(low), starts, ends)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``size``-word shingle hashes of each text, concatenated, and their offsets. Texts with fewer words give their whole sequence as one shingle; texts without words give nothing."""
    low, starts, ends, first = words(buf, offs)
    h = word_hashes(low, starts, ends)
    n = len(h)
    s = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        s = mix64(s * np.uint64(31) + h[k : n - size + 1 + k] + np.uint64(k + 1)) if len(s) else s
    out, lens = [], np.zeros(len(offs) - 1, np.int64)
    for d in range(len(offs) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            x = np.sort(s[a : b - size + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(b - a):
                x = mix64(x * np.uint64(37) + h[a + k : a + k + 1] + np.uint64(1000 + b - a))
        else:
            continue
        lens[d] = len(x)
        out.append(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(lens)))
