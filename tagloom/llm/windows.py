"""Grouping of fixed-length windows by content-defined anchors.

Two equal windows choose the same anchor (the smallest hash among their k-grams, leftmost on ties), so rows that
share an anchor are the only ones that can hold equal windows.  A *segment* is a run of neighbouring windows of one
text with the same anchor; each window lies in exactly one segment.
"""

from __future__ import annotations

import numpy as np

_MASK_BITS = 20
#: Most symbols that one call of :func:`segment_runs` takes, since positions share a word with hash bits.
MAX_SYMBOLS = 1 << _MASK_BITS
#: Most windows of one segment; longer runs are cut.
MAX_WINDOWS = 4096

_rng = np.random.default_rng(20240229)
#: Random 64-bit value for each byte, and an odd multiplier for each doubling step of the rolling hash.
BYTE_HASH = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MULT = _rng.integers(0, 2**63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any bits of the result may serve as a hash."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def kgram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a uint64 array; k is a power of two."""
    h, m, step = symbols, 1, 0
    while m < k:
        h = h[:-m] * _MULT[step] + h[m:]
        m, step = 2 * m, step + 1
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segment_runs(symbols: np.ndarray, window: int, k: int):
    """Segments of one text: anchor hashes, first windows, numbers of windows, and whether the anchor stands in them at several places.

    Window j is symbols[j : j + window].  Two equal windows of one segment lie around different places of its anchor,
    so a segment with one place holds no repeat by itself.  Texts shorter than the window give nothing.
    """
    n = len(symbols) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = kgram_hashes(symbols, k)
    low = np.uint64(MAX_SYMBOLS - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(keyed, window - k + 1) & low).astype(np.int64)
    anchor = grams[place]
    moved = np.r_[False, np.diff(place) != 0]
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[cut, n])
    if count.max() > MAX_WINDOWS:
        cut = np.concatenate([np.arange(c, c + m, MAX_WINDOWS) for c, m in zip(cut.tolist(), count.tolist(), strict=True)])
        count = np.diff(np.r_[cut, n])
    steps = np.r_[0, np.cumsum(moved)]
    return anchor[cut], cut, count, steps[cut + count] > steps[cut + 1]
