"""Benchmark decontamination by the q-gram lemma.

A passage is any stretch of ``length`` normal characters of a benchmark item, at whatever offset, or all of a shorter
item.  A text region within k edits of a passage of m characters shares at least m - q + 1 - k q of its q-grams, on
diagonals that spread over at most k.  Windows with fewer shared q-grams are passed over; in the others the q-grams
of whole items are counted in overlapping diagonal bands, and all passages that reach the bound in a band are
verified by banded alignment, many at a time.  Equal passages of an item are looked for once, and texts are worked off
in slices that overlap by a passage, so memory doesn't grow with the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import materialize, only, scan, texts
from tagloom.llm.licenses import normal_words
from tagloom.llm.windows import BYTE_HASH, mix

#: Most characters of benchmark text that one pass takes; larger benchmarks are worked off in blocks of this size.
BLOCK_CHARS = 1 << 20
_STEP = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Characters of text that are looked at together, and pairs of a text place and an item place that are held at a time.
SLICE, PAIRS = 8192, 1 << 20
#: Neighbouring bands that are aligned together at most.
MERGED = 4


@dataclass(frozen=True)
class Rule:
    """length: of passages in normal characters; step: of passages of one stretch as they are counted; edit_rate: edits for each character; q: size of a gram."""

    length: int = 120
    step: int = 60
    edit_rate: float = 0.05
    q: int = 12

    def edits(self, m: int) -> int:
        return int(m * self.edit_rate)

    def gram(self, m: int) -> int:
        """Size of grams for passages of m characters: smaller for short ones, so that the lemma promises one at least."""
        return min(self.q, m // (self.edits(m) + 1))

    def shared(self, m: int) -> int:
        """Grams that a passage of m characters shares at least with a region that matches."""
        return m + 1 - self.gram(m) * (self.edits(m) + 1)


def normal(text: str) -> bytes:
    """Lower-case words joined by blanks."""
    return b" ".join(normal_words(text))


def grams(line: bytes, q: int) -> np.ndarray:
    """Hashes of the q-grams of a line."""
    h = BYTE_HASH[np.frombuffer(line, np.uint8)]
    n = len(h) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, size, at, m, step = None, q, 0, 1, 0
    while size:  # doubling; the parts for the set bits of q are put together
        if size & 1:
            part = h[at : at + n]
            out = part if out is None else out * _STEP[32 + step] + part
            at += m
        size >>= 1
        if size:
            h = h[:-m] * _STEP[step] + h[m:]
            m, step = 2 * m, step + 1
    return mix(out)


class Item:
    """A benchmark item: its key, normal form, passage length m, edits k, gram size q and least number of shared grams.

    ``first`` tells which starts of passages are the first ones of their content, ``same`` for each start the first
    one of the same content.
    """

    def __init__(self, key, line: bytes, rule: Rule):
        self.key, self.line, self.m = key, line, min(len(line), rule.length)
        self.k, self.q, self.least = rule.edits(self.m), rule.gram(self.m), rule.shared(self.m)
        self.whole_words = len(line) < rule.q  # an item so short counts only where it stands as words of its own
        _, at, of = np.unique(grams(line, self.m), return_index=True, return_inverse=True)
        self.same = at[of]
        self.first = np.zeros(len(of), bool)
        self.first[at] = True
        cover = np.zeros(len(of) + self.m - self.q + 2, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.m - self.q + 1, -1)
        self.offsets = np.flatnonzero(np.cumsum(cover)[:-1] > 0)  # grams of first passages


class Table:
    """Items of one gram size with their grams, and a table of bits that tells which hashes may be among them."""

    def __init__(self, items: list[Item], q: int):
        self.items, self.q = items, q
        keys = np.concatenate([grams(x.line, q)[x.offsets] for x in items])
        owner = np.repeat(np.arange(len(items)), [len(x.offsets) for x in items])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.offset = keys[order], owner[order], np.concatenate([x.offsets for x in items])[order]
        self.shift = np.uint64(64 - max(16, int(32 * len(keys) - 1).bit_length()))
        self.bits = np.zeros(1 << 64 - int(self.shift), bool)
        self.bits[keys >> self.shift] = True
        self.least, self.span = min(x.least for x in items), max(x.m + x.k for x in items)

    def find(self, line: bytes, found: dict) -> None:
        """Add to ``found``, by item, the passages that match in a normal line: (start, begin, end, edits) of each."""
        h = grams(line, self.q)
        hit = np.flatnonzero(self.bits[h >> self.shift]) if len(h) else h
        if len(hit) < self.least:
            return
        # of each run of `least` hits, those that one matching region can hold
        near = np.flatnonzero(hit[self.least - 1 :] - hit[: len(hit) - self.least + 1] <= self.span)
        keep = np.zeros(len(hit) + 1, np.int64)
        np.add.at(keep, near, 1)
        np.add.at(keep, near + self.least, -1)
        hit = hit[np.cumsum(keep)[:-1] > 0]
        if not len(hit):
            return
        low, high = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
        real = high > low
        hit, low, high = hit[real], low[real], high[real]
        a = 0
        while a < len(hit):  # a slice of places, and behind it as many as a region that begins in it may take
            b = int(np.searchsorted(hit, hit[a] + SLICE))
            z = int(np.searchsorted(hit, hit[b - 1] + self.span))
            self._slice(line, hit[a:z], low[a:z], high[a:z], found)
            a = b

    def _slice(self, line: bytes, hit: np.ndarray, low: np.ndarray, high: np.ndarray, found: dict) -> None:
        counts = high - low
        total = np.cumsum(counts)

        def pairs():
            """Owners, offsets and places, some at a time."""
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(total // PAIRS)) + 1):
                n = counts[part]
                rows = np.repeat(low[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                yield self.owner[rows], self.offset[rows], np.repeat(hit[part], n)

        each = sum(np.bincount(owner, minlength=len(self.items)) for owner, _, _ in pairs())
        wanted = np.flatnonzero(each >= [x.least for x in self.items])
        for some in np.split(wanted, np.flatnonzero(np.diff(np.cumsum(each[wanted]) // PAIRS)) + 1):
            if not len(some):
                continue
            asked = np.zeros(len(self.items), bool)
            asked[some] = True
            owner, offset, at = (np.concatenate(c) for c in zip(*((o[k], f[k], p[k]) for o, f, p in pairs() for k in [asked[o]]), strict=True))
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            for rows in np.split(order, cuts):
                self._bands(line, int(owner[rows[0]]), offset[rows], at[rows], found)

    def _bands(self, line: bytes, owner: int, offset: np.ndarray, at: np.ndarray, found: dict) -> None:
        x = self.items[owner]
        if x.whole_words:  # the item is one gram
            free = [a for a in at.tolist() if (a == 0 or line[a - 1] == 32) and (a + x.m == len(line) or line[a + x.m] == 32)]
            if free:
                begin = np.array(free)
                found.setdefault(x, []).append((begin * 0, begin, begin + x.m, begin * 0))
            return
        order = np.lexsort((offset, at - offset))
        diagonal, offset = (at - offset)[order], offset[order]
        width, last = x.k + 1, len(x.line) - x.m
        band = np.floor_divide(diagonal, width)
        both = np.concatenate([band, band - 1])  # band n holds diagonals from n * width over 2 * width
        base, n = int(both.min()), len(x.line)
        table = np.unique((both - base) * n + np.tile(offset, 2))
        numbers, begin, counts = np.unique(table // n + base, return_index=True, return_counts=True)
        table %= n
        crowds: list[list] = []  # first band, last band, starts
        for n, f, c in zip(numbers.tolist(), begin.tolist(), counts.tolist(), strict=True):
            if c < x.least:
                continue
            starts = crowded(table[f : f + c], x.least, x.m - x.q, last)
            starts = starts[x.first[starts]]
            if len(starts):
                if crowds and n - crowds[-1][1] == 1 and n - crowds[-1][0] < MERGED:
                    crowds[-1][1], crowds[-1][2] = n, np.union1d(crowds[-1][2], starts)
                else:
                    crowds.append([n, n, starts])
        for low, high, starts in crowds:
            a, b = low * width, (high + 2) * width
            i, j = np.searchsorted(diagonal, [a, b])
            one, other = unedited(diagonal[i:j], offset[i:j], x.m - x.q + 1, starts)
            whole = one <= other
            s = starts[whole]
            rows = [(s, one[whole] + s, other[whole] + s + x.m, s * 0)]
            if x.k and not whole.all():
                rest = starts[~whole]
                first, end, edits = align_all(x.line, rest, x.m, line, a, b - a, x.k)
                rows.append(tuple(c[edits <= x.k] for c in (rest, first, end, edits)))
            for s, first, end, edits in rows:
                if len(s):
                    found.setdefault(x, []).append((s, first, end, edits))


class Index:
    """Items by the size of their grams."""

    def __init__(self, items: list[tuple[int, str]], rule: Rule):
        self.rule = rule
        by_size: dict[int, list[Item]] = {}
        for key, text in items:
            if line := normal(text or ""):
                x = Item(key, line, rule)
                by_size.setdefault(x.q, []).append(x)
        self.tables = [Table(xs, q) for q, xs in sorted(by_size.items())]

    def find(self, line: bytes) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, fewest edits, passages) of each item with a passage that matches in a normal line."""
        found: dict = {}
        for t in self.tables:
            t.find(line, found)
        out = []
        for x, hits in found.items():
            met = np.zeros(len(x.same), bool)
            for s, *_ in hits:
                met[s] = True
            runs = np.flatnonzero(np.diff(np.r_[False, met[x.same], False]))  # all starts whose content was found
            passages = sum(1 + (b - a - 1) // self.rule.step for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True))
            out.append((x.key, min(int(f.min()) for _, f, _, _ in hits), max(int(e.max()) for _, _, e, _ in hits), min(int(d.min()) for *_, d in hits), passages))
        return out


def unedited(d: np.ndarray, o: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the starts the lowest and highest diagonal on which the n grams from there on all match; high before low if none.

    The grams' diagonals and offsets are in order.
    """
    run = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1] + 1), [True]]))
    low, high = np.full(len(starts), np.iinfo(np.int64).max), np.full(len(starts), np.iinfo(np.int64).min)
    for a, b in zip(run[:-1].tolist(), run[1:].tolist(), strict=True):
        if b - a >= n:
            i, j = np.searchsorted(starts, o[a]), np.searchsorted(starts, o[b - 1] - n + 1, "right")
            low[i:j], high[i:j] = np.minimum(low[i:j], d[a]), np.maximum(high[i:j], d[a])
    return low, high


def crowded(offsets: np.ndarray, least: int, span: int, last: int) -> np.ndarray:
    """Starts from 0 to ``last`` with ``least`` or more of the sorted different offsets within ``span`` after them."""
    i, j = offsets[: len(offsets) - least + 1], offsets[least - 1 :]
    near = j - i <= span
    low, high = np.maximum(j[near] - span, 0), np.minimum(i[near], last)
    some = low <= high
    low, high = low[some], high[some]
    if not len(low):
        return np.zeros(0, np.int64)
    # both ends rise, so what is new in each range lies past the one before
    low = np.maximum(low, np.r_[0, high[:-1] + 1])
    size = np.maximum(high - low + 1, 0)
    return np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def align_all(item: bytes, starts: np.ndarray, m: int, line: bytes, diagonal: int, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and edits of the closest region of ``line`` for each passage of m characters of ``item`` from ``starts``.

    The path stays in the diagonals of the whole item from ``diagonal`` on over ``width``, and k beside them; edits are
    over k where there is no region.
    """
    low, size = diagonal - k, width + 2 * k + 1
    big = k + m + len(line) + 1
    begin, end, edits = (np.zeros(len(starts), np.int64) for _ in range(3))
    chars, text = np.frombuffer(item, np.uint8), np.frombuffer(line, np.uint8)
    step = np.arange(size)
    for c in range(0, len(starts), 1024):
        a = starts[c : c + 1024, None]
        position = a + low + step
        cost = np.where((position >= 0) & (position <= len(line)), 0, big)
        start = position
        for i in range(m):
            here = position + i
            inside = (here >= 0) & (here < len(line))
            same = cost + ((text[np.where(inside, here, 0)] != chars[a + i]) | ~inside)
            up, before = np.full(cost.shape, big), np.zeros(cost.shape, np.int64)
            up[:, :-1], before[:, :-1] = cost[:, 1:] + 1, start[:, 1:]
            best = np.minimum(same, up)
            origin = np.where(same <= up, start, before)
            run = np.minimum.accumulate(best - step, axis=1)
            source = np.maximum.accumulate(np.where(best - step == run, step, 0), axis=1)
            cost, start = run + step, np.take_along_axis(origin, source, axis=1)
            cost = np.where((here + 1 >= 0) & (here + 1 <= len(line)), cost, big)
        d = np.argmin(cost, axis=1)
        rows = np.arange(len(d))
        begin[c : c + 1024], end[c : c + 1024], edits[c : c + 1024] = start[rows, d], position[rows, d] + m, cost[rows, d]
    return begin, end, edits


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS):
    """Lists of (item_id, text) of at most ``limit`` characters, or of one longer item; null texts are left out."""
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").distinct().toLocalIterator():
        if block and size + len(r[1]) > limit:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:  # noqa: B008
    """A row for each row of docs and different benchmark row with a match: ``keep``, item_id, n_passages, edits, start_word, end_word.

    Words are those of the normal form, counted from 0, ends exclusive; edits are the fewest of a passage; passages
    are different ones of the item, those that follow one another counted at the rule's step.  Texts without a match,
    null and empty ones give no row; repeated documents give repeated rows; benchmark rows that repeat id and text
    count once, and null or empty ones never.  Items of fewer characters than a gram match where they stand as words.
    Only a block of the benchmark is held at a time, and blocks don't change the result.
    """
    docs = only(docs, *dict.fromkeys((*keep, text)))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL("item_id long, n_passages long, edits long, start_word long, end_word long").fields])

    def worker(items: list[tuple[int, str]]) -> Callable:
        def rows(batch: pa.RecordBatch, index: Index) -> list | None:
            at, out = [], []
            for i, t in enumerate(texts(batch, text)):
                line = normal(t)
                if hits := index.find(line):
                    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    for item, a, b, edits, passages in sorted(hits, key=lambda h: (h[0] is None, h[0] or 0, h[1:])):
                        at.append(i)
                        out.append((item, passages, edits, int(np.searchsorted(blanks, a)), int(np.searchsorted(blanks, b)) + 1))
            if not at:
                return None
            chosen = batch.take(pa.array(at))
            return [*(chosen.column(c) for c in keep), *map(list, zip(*out, strict=True))]

        return scan(docs, rows, schema, lambda: Index(items, rule))

    parts: list[DataFrame] = []
    for items in blocks(benchmark, block_chars):
        parts = [*parts[:-1], *(materialize(p) for p in parts[-1:]), worker(items)]  # earlier blocks are done with
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:  # noqa: B008
    """``docs`` without the rows whose text matches a benchmark item; the others keep all columns.

    Null and empty texts stay, whole texts are looked at however long, repeated rows are judged alike, and an empty
    table stays empty.  Each block of the benchmark filters what the blocks before have kept.
    """
    names, schema = docs.columns, docs.schema

    def worker(items: list[tuple[int, str]], frame: DataFrame) -> DataFrame:
        def rows(batch: pa.RecordBatch, index: Index) -> list | None:
            clean = [not index.find(normal(t)) for t in texts(batch, text)]
            kept = batch.filter(pa.array(clean, pa.bool_()))
            return [kept.column(c) for c in names] if kept.num_rows else None

        return scan(frame, rows, schema, lambda: Index(items, rule))

    for i, items in enumerate(blocks(benchmark, block_chars)):
        docs = worker(items, materialize(docs) if i else docs)
    return docs
