"""Suffix order, Burrows-Wheeler transform and threshold-bounded interval expansion on one index's text."""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text holds; it stands between texts.
SEPARATOR = 0xFF


def suffix_order(first: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols at least, by prefix doubling.

    ``first`` ranks each position by its first ``span`` symbols.  Positions that agree in all symbols compared stand
    in any order; intervals of prefixes no longer than ``depth`` hold such positions together.
    """
    n = len(first)
    order = np.argsort(first)
    # as many ranks as fit side by side into 64 bits are compared at a time
    width = np.uint64(max(1, n.bit_length()))
    ways = 3 if 3 * int(width) <= 64 else 2
    while True:
        sorted_ = first[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]), dtype=np.uint64)
        if span >= depth or rank[order[-1]] == n - 1:
            return order
        rank += np.uint64(1)  # 0 stands for what is past the end
        first = rank.copy()
        for way in range(1, ways):
            first <<= width
            first[: n - min(n, way * span)] |= rank[way * span :]
        order = np.argsort(first)
        span *= ways


def byte_ranks(text: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as one number."""
    key = text.astype(np.uint64)
    for step in (1, 2, 4):
        later = np.zeros_like(key)
        later[:-step] = key[step:]
        key = (key << np.uint64(8 * step)) | later
    return key


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Boundaries p in the suffix order where suffixes p - 1 and p share at least ``least`` symbols, as a bool array.

    Common prefixes are found by increasing length: an interval of suffixes with prefix w, extended backwards by each
    symbol c before it, gives the interval of cw; the boundary behind that is new exactly if its common prefix is as
    long as w.  Expansion goes breadth first and ends before length ``least``, so boundaries not met are the result.
    """
    n = len(text)
    last = text[order - 1]  # the symbol before each suffix
    by_symbol = np.argsort(last, kind="stable")
    kind = np.int32 if n < 1 << 31 else np.int64
    by_symbol = by_symbol.astype(kind)
    back = np.empty(n, kind)
    back[by_symbol] = np.arange(n, dtype=kind)
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    after, prior = np.full(n, n, kind), np.full(n, -1, kind)  # next and previous place of the same symbol
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    prior[by_symbol[1:][same]] = by_symbol[:-1][same]
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    heads = np.flatnonzero(np.concatenate([[True], ~same])).astype(kind)
    low, high = heads, np.concatenate([heads[1:] - 1, np.array([n - 1], kind)])  # intervals of single symbols: common prefixes of length 0 end here
    low, high = _fresh(open_, low, high)
    # the last interval has no boundary behind it, but its extensions have
    low, high = np.concatenate([low, heads[-1:]]), np.concatenate([high, np.array([n - 1], kind)])
    for _ in range(1, least):
        if not len(low):
            break
        one = low == high
        single = back[low[one]]
        lo, hi = low[~one], high[~one]
        size = hi - lo + 1
        total = int(size.sum())
        if total:
            step = np.ones(total, kind)  # places of all intervals, one after another
            begin = np.cumsum(size[:-1])
            step[0], step[begin] = lo[0], lo[1:] - hi[:-1]
            q = np.cumsum(step, dtype=kind)
            ends = after[q] > np.repeat(hi, size)
            begins = prior[q] < np.repeat(lo, size)
            # intervals of one length don't overlap, so their ends in order belong to their begins in order
            low, high = np.concatenate([single, np.sort(back[q[begins]])]), np.concatenate([single, np.sort(back[q[ends]])])
        else:
            low, high = single, single
        low, high = _fresh(open_, low, high)
    return open_[:n]


def _fresh(open_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals whose boundary behind them is met for the first time; it is closed."""
    new = open_[high + 1]
    low, high = low[new], high[new]
    open_[high + 1] = False
    return low, high


def repeated_starts(texts: list[bytes], window: int, weights: list[int] | None = None) -> list[np.ndarray]:
    """For each text, the starts of its windows (of ``window`` bytes) that start anywhere else too.

    ``weights`` tells how often each text occurs; suffixes that share ``window`` bytes count as often as their texts do.
    """
    sep = bytes([SEPARATOR])
    text = np.frombuffer(sep + sep.join(texts) + sep, np.uint8)
    order = suffix_order(byte_ranks(text), 8, window)
    group = np.cumsum(~long_prefixes(text, order, window))
    times = np.repeat(np.array([0, *(weights or [1] * len(texts))], np.int64), [1, *(len(t) + 1 for t in texts)])  # separators never begin a window
    flag = np.empty(len(text), bool)
    flag[order] = (np.bincount(group, times[order]) >= 2)[group]
    out, at = [], 1
    for t in texts:
        out.append(np.flatnonzero(flag[at : at + max(0, len(t) - window + 1)]))
        at += len(t) + 1
    return out
