"""Words of text batches as 64-bit hashes, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import mix

#: The separators 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 48


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each row begins and the last ends; null counts as empty."""
    col = column.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a with a final mix, of data[start:end] for all spans at once."""
    h = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    size = end - start
    prime = np.uint64(0x100000001B3)
    live = np.flatnonzero(size > 0)
    k = 0
    while len(live) and k < LONG_WORD:
        h[live] = (h[live] ^ data[start[live] + k]) * prime
        k += 1
        live = live[size[live] > k]
    h = mix(h)
    for i in live:
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def spans(blank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that aren't blank, cut at row ends; and how many come before each row."""
    n = len(blank)
    solid = ~blank
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:] = blank[:-1]
        after[:-1] = blank[1:]
        before |= cut[:-1]
        after |= cut[1:]
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, at)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^ 0x20 0x09-0x0D]+ of all rows, A-Z lower-cased, and how many come before each row."""
    data, at = text_bytes(column)
    start, end, first = spans(SPACE[data], at)
    return hash_spans(LOWER[data], start, end), first


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i:i+n] for each i; the order of the words counts."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _ODD[k % len(_ODD)]
        out ^= out >> np.uint64(29)
    return mix(out)
