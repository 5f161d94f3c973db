"""Vectorised word handling over Arrow string buffers.

Everything here works on whole documents: a batch is cut into blocks of whole
documents of about ``block_bytes`` so that temporaries stay small, and a document
longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of the plain-word rule: every ASCII byte but letters and digits.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown as longer blocks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, by one prefix polynomial."""
    _POWERS.need(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _POWERS.up[: len(data)]
    np.cumsum(terms, out=prefix[1:])
    h = prefix[ends]
    h -= prefix[starts]
    h *= _POWERS.down[starts]
    h ^= (ends - starts).astype(np.uint64) << np.uint64(56)
    return mix(h)


def blocks(texts: pa.Array, block_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row in bytes) of runs of whole rows; null rows are empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts, np.int32
    n = len(texts)
    if n == 0:
        return
    _, at, raw = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if texts.null_count:
        null = texts.is_null().to_numpy(zero_copy_only=False)
        if lengths[null].any():
            texts = pa.array(["" if x is None else x for x in texts.to_pylist()], pa.string())
            yield from blocks(texts, block_bytes)
            return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered(texts: pa.Array, block_bytes: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """blocks() of the lower-cased texts, a few rows at a time."""
    for at in range(0, len(texts), rows):
        low = pa.array([None if x is None else x.lower() for x in texts.slice(at, rows).to_pylist()], pa.large_string())
        for lo, data, offsets in blocks(low, block_bytes):
            yield at + lo, data, offsets


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the index of the first word of each row (one more at the end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    letter = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, letter[1:]
    starts = np.flatnonzero(letter & (~before | cut[:-1]))
    ends = np.flatnonzero(letter & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(h) - k + 1 of them, none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)
