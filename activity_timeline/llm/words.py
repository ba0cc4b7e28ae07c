"""Words and windows of words as 64-bit hashes, worked out on whole batches."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95      # odd
BLOCK = 1 << 19                # bytes of text hashed at once
SLICE_BYTES = 2 << 20          # text of a sub-batch


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    ones = np.full(n, BASE, np.uint64)
    back = np.full(n, pow(BASE, -1, 2**64), np.uint64)
    ones[0] = back[0] = 1
    return np.cumprod(ones), np.cumprod(back)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(BLOCK * 2, 1 << int(n - 1).bit_length()) if n else 2)


@lru_cache(2)
def _bytes(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte; whether a byte is white space."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MIX))
    if lower:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


def token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """The batch in pieces of about `limit` bytes of `column`, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins (one more at the end)."""
    texts = pc.fill_null(texts, "")
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None or not len(wide):
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and where each text's words begin.

    With `lower`, A-Z count as a-z.
    """
    data, offsets = text_buffer(texts)
    found, starts_at = [], []
    at = 0
    while at < len(data):
        stop = _cut(data, offsets, at)
        h, s = _block(data[at:stop], offsets[np.searchsorted(offsets, at):
                                             np.searchsorted(offsets, stop, "right")] - at, lower)
        found.append(h)
        starts_at.append(s + at)
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_at)
    return np.concatenate(found), np.searchsorted(starts, offsets)


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """A place between words about BLOCK bytes after `at`."""
    stop = at + BLOCK
    if stop >= len(data):
        return len(data)
    space = _bytes(False)[1]
    while True:
        edge = offsets[min(np.searchsorted(offsets, stop), len(offsets) - 1)]
        blank = np.flatnonzero(space[data[stop:stop + BLOCK]])
        nearest = stop + blank[0] if len(blank) else stop + BLOCK
        if nearest >= edge or len(blank) or nearest >= len(data):
            return int(min(nearest, edge, len(data)))
        stop = nearest


def _block(data: np.ndarray, edges: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    values, space = _bytes(lower)
    word = ~space[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts]
               + (stops - starts).astype(np.uint64)), starts


def window_hashes(hashes: np.ndarray, size: int, at: np.ndarray | None = None,
                  first: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of `size` hashes, in order; or of those `at`, begun with `first`."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    if at is not None:
        return mix((total[at + size] - total[at]) * down[at] - hashes[at] + first)
    return mix((total[size:] - total[:n]) * down[:n])


def window_starts(first_word: np.ndarray, size: int, n_windows: int) -> np.ndarray:
    """Which runs of `size` words lie in one text: a flag per run; first_word as in word_hashes."""
    inside = np.ones(n_windows, bool)
    for edge in first_word[1:-1].tolist():
        inside[max(0, edge - size + 1):edge] = False
    return inside
