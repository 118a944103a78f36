"""Vectorised tokenising and hashing of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Every word gets a
64-bit polynomial hash computed from prefix sums over the whole buffer, so no
Python object per word is ever made.  Memory beyond the text itself is bounded
by ``STEP`` bytes of text at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LEN = np.uint64(0xD6E8FEB86659FD93)
_GRAM = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, STEP + 1), base, dtype=np.uint64)
        full[0] = 1
        _powers[name] = have = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word's number of each text."""
    if len(raw) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are disjoint and ascending."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, "right")))
        base, stop = starts[first], ends[last - 1]
        piece = raw[base:stop].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _power(_P, len(piece), "p"), dtype=np.uint64, out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        poly = (sums[b] - sums[a]) * _power(_P_INV, len(piece) + 1, "i")[a]
        out[first:last] = mix(poly + (b - a).astype(np.uint64) * _LEN)
        first = last
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word number (one more at the end)."""
    raw, at = buffers(column)
    raw = lowered(raw)
    starts, ends, first = words(raw, at)
    return span_hashes(raw, starts, ends), first


def shingles(word: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one n-gram."""
    n = len(word)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        total += word[k : n - size + 1 + k] * _GRAM[k % len(_GRAM)] ^ np.uint64(k)
    return np.unique(mix(total))


def slices(batch: pa.RecordBatch, text: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a cut have about ``limit`` bytes; a longer text comes alone.

    A cut's arrays take some 20 times its bytes; what they freed goes back to the system after the last.
    """
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, stop - row)
        row = stop
    trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)
