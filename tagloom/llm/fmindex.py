"""FM-index over words, with a wavelet matrix of packed digits, and matching statistics by backward search."""

from __future__ import annotations

import numpy as np

from tagloom.llm.bwt import suffix_order

#: Of a packed word with sixteen digits of four bits: the lowest bit of each of the first n digits, for every n.
_FIRST = np.array([0x1111111111111111 & ((1 << 4 * n) - 1) for n in range(16)], np.uint64)
#: Each digit sixteen times.
_SAME = np.array([0x1111111111111111 * d for d in range(16)], np.uint64)


class WaveletMatrix:
    """Rank queries over integers, four bits a level: packed digits, with counts of each digit before each sixteen."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, -(-int(sigma - 1).bit_length() // 4))
        self.words, self.counts, self.starts = [], [], []
        for level in range(self.levels - 1, -1, -1):
            digit = ((values >> 4 * level) & 15).astype(np.uint8)
            blocks = len(digit) // 16 + 1
            padded = np.zeros(16 * blocks, np.uint64)
            padded[: len(digit)] = digit
            self.words.append(np.bitwise_or.reduce(padded.reshape(blocks, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=1))
            each = np.bincount((np.arange(len(digit)) & ~15) + digit, minlength=16 * blocks).reshape(blocks, 16)
            before = np.cumsum(each, axis=0) - each
            totals = before[-1] + each[-1]
            # where a digit's values begin on the next level is added to its counts at once
            self.counts.append((before + np.cumsum(totals) - totals).astype(np.int32).ravel())
            values = values[np.argsort(digit, kind="stable")]

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place ``at`` comes to on the way of ``symbol`` through all levels."""
        for level in range(self.levels):
            digit = (symbol >> 4 * (self.levels - 1 - level)) & 15
            other = self.words[level].take(at >> 4)
            other ^= _SAME.take(digit)
            other |= other >> np.uint64(1)
            other |= other >> np.uint64(2)
            np.bitwise_not(other, out=other)
            other &= _FIRST.take(at & 15)
            at = self.counts[level].take((at & ~15) + digit) + np.bitwise_count(other)
        return at.astype(np.int64)


class FmIndex:
    """Index of word sequences: ids from 1 on, one after another, and the sizes of the sequences; 0 stands between them.

    ``weights`` tells how often each sequence occurs; a match counts as often as its sequence does.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, depth: int, weights: np.ndarray):
        number = np.repeat(np.arange(len(sizes)), sizes)
        self.text = np.zeros(len(ids) + len(sizes) + 1, np.int64)
        place = np.arange(len(ids)) + number + 1
        self.text[place] = ids
        self.sigma = int(self.text.max()) + 1
        order = suffix_order(self.text.astype(np.uint64), 1, depth)
        times = np.zeros(len(self.text), np.int64)
        times[place] = weights[number]
        self.times = np.concatenate([[0], np.cumsum(times[order])])
        self.tree = WaveletMatrix(self.text[order - 1], self.sigma)
        symbols = np.arange(self.sigma)
        before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.sigma))[:-1]])
        # place of a symbol's suffixes, less where its way through the levels begins
        self.shift = before - self.tree.descend(symbols, np.zeros(self.sigma, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches preceded by ``symbol``."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def repeated_starts(self, text: np.ndarray, sizes: np.ndarray, window: int) -> list[np.ndarray]:
        """For each sequence streamed against the index, the starts of windows found at two places at least.

        Each goes from its end backwards as long as two places match.  Where that fails, every window over the failing
        stretch is settled, and the search begins again with the latest end that is still open.
        """
        base = np.cumsum(sizes) - sizes
        flag = np.zeros(len(text) + 1, bool)
        lane = np.flatnonzero(sizes >= window)
        end, at = sizes[lane].copy(), sizes[lane].copy()
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), len(self.text), np.int64)
        while len(lane):
            lo, hi = self.extend(text[base[lane] + at - 1], low, high)
            ok = self.times[hi] - self.times[lo] >= 2
            at = np.where(ok, at - 1, at)
            flag[(base[lane] + at)[ok & (end - at >= window)]] = True
            again = np.minimum(end - 1, at - 1 + window)
            end, at = np.where(ok, end, again), np.where(ok, at, again)
            low, high = np.where(ok, lo, 0), np.where(ok, hi, len(self.text))
            on = (at > 0) & (end >= window)
            if not on.all():
                lane, end, at, low, high = lane[on], end[on], at[on], low[on], high[on]
        return [np.flatnonzero(flag[b : b + max(0, n - window + 1)]) for b, n in zip(base, sizes, strict=True)]


def word_repeats(lines: list[bytes], window: int, weights: list[int] | None = None) -> list[np.ndarray]:
    """:meth:`FmIndex.repeated_starts` of lines of words joined by blanks, against an index of the same lines."""
    words = b" ".join(lines).split(b" ")
    number = {w: i for i, w in enumerate(set(words), 1)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    sizes = np.fromiter((line.count(b" ") + 1 for line in lines), np.int64, len(lines))
    return FmIndex(ids, sizes, window, np.array(weights or [1] * len(lines))).repeated_starts(ids, sizes, window)
