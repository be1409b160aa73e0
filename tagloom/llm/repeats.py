"""Repeated passages across documents: windows are dealt by anchor, indexed per shard, and their texts cut.

1. Each text becomes segments (see windows.py); anchors that occur once in the corpus hold no repeat and go no further.
2. Segments of one anchor and content are one row with a count, so copies and common passages cost one row each.
3. The contents of all other anchors are dealt to shards; a shard indexes them, a few anchors at a time, each weighted
   with its count, and finds the windows that occur twice.  Anchors with very many contents are dealt by a second,
   finer anchor first.
4. The spans found go back to the texts, where the words or bytes that they cover are removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.bwt import repeated_starts
from tagloom.llm.common import discard, materialize, only, scan
from tagloom.llm.fmindex import word_repeats
from tagloom.llm.windows import BYTE_HASH, MAX_SYMBOLS, mix, segment_runs

#: Anchors with more contents than this are dealt by finer anchors, up to so many times.
MANY, LEVELS = 8192, 4


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``window`` symbols, anchored on ``gram`` of them; ``words`` or bytes.

    One index is built over about ``index_bytes`` of text; an anchor's segments stay together.
    """

    words: bool
    window: int
    gram: int
    index_bytes: int = 3 << 19

    def line(self, text: bytes) -> bytes:
        """The text in the form that offsets refer to: words joined by one blank, or the bytes themselves."""
        return b" ".join(text.split()) if self.words else text

    def symbols(self, line: bytes) -> np.ndarray:
        """Hashes of the symbols."""
        if not self.words:
            return BYTE_HASH[np.frombuffer(line, np.uint8)]
        words = line.split(b" ") if line else []
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def begins(self, line: bytes) -> np.ndarray | None:
        """Where each word begins in the line, with one more for the end; None for bytes."""
        if not self.words:
            return None
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20) + 1
        return np.concatenate([[0], blanks, [len(line) + 1]]) if line else np.zeros(1, np.int64)

    def cut(self, line: bytes, begins: np.ndarray | None, start: int, end: int) -> bytes:
        """Symbols start to end of the line."""
        return line[start:end] if begins is None else line[begins[start] : begins[end] - 1]

    def repeated(self, bodies: list[bytes], weights: list[int]) -> list[np.ndarray]:
        """Starts of the windows of each body that occur twice, bodies counted with their weights."""
        return word_repeats(bodies, self.window, weights) if self.words else repeated_starts(bodies, self.window, weights)


def runs_of(line: bytes, unit: Unit, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a line (see :func:`segment_runs`); very long lines go in overlapping parts.

    Each ``level`` chooses anchors by another hash.
    """
    symbols = unit.symbols(line)
    if level:
        symbols = mix(symbols + np.uint64(level))
    found = []
    for at in range(0, max(1, len(symbols) - unit.window + 1), MAX_SYMBOLS - unit.window + 1):
        anchors, first, count, several = segment_runs(symbols[at : at + MAX_SYMBOLS], unit.window, unit.gram)
        found.append((anchors, first + at, count, several))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digest(body: bytes) -> int:
    return signed(xxhash.xxh3_64_intdigest(body, 77))


#: A text is known by its XXH64 and CRC32: the same in the JVM and here.
KEY = ("tk", "tc")


def with_key(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, the body (null: empty) and its key."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(*(F.col(f"`{c}`") for c in keep), body.alias("_body"), F.xxhash64(body).alias("tk"), F.crc32(body.cast("binary")).alias("tc"))


def anchors(docs: DataFrame, unit: Unit, text: str = "text") -> DataFrame:
    """anchor of every segment of every row, and c: 2 if it stands there at several places, else 1."""

    def rows(batch: pa.RecordBatch) -> list | None:
        found = [runs_of(unit.line(t.as_py().encode()), unit) for t in batch.column(text) if t.as_py()]
        return [np.concatenate([f[0] for f in found]).view(np.int64), (np.concatenate([f[3] for f in found]) + 1).astype(np.int32)] if found else None

    return scan(only(docs, text), rows, "anchor long, c int")


def segments(docs: DataFrame, unit: Unit, text: str = "text") -> DataFrame:
    """anchor, dg (hash of the content), tk, tc, start, count of every segment of every row."""

    def rows(batch: pa.RecordBatch) -> list | None:
        out: list[list] = [[], [], [], [], [], []]
        for t in batch.column(text):
            raw = t.as_py()
            if not raw:
                continue
            raw = raw.encode()
            line = unit.line(raw)
            found, first, count, _ = runs_of(line, unit)
            if not len(found):
                continue
            begins, ends = unit.begins(line), first + count + unit.window - 1
            a, b = (first, ends) if begins is None else (begins[first], begins[ends] - 1)
            out[0].append(found.view(np.int64))
            out[1] += [digest(line[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            out[2].append(np.full(len(first), signed(xxhash.xxh64_intdigest(raw, 42)), np.int64))
            out[3].append(np.full(len(first), zlib.crc32(raw), np.int64))
            out[4].append(first)
            out[5].append(count)
        if not out[0]:
            return None
        return [pa.array(c if i == 1 else np.concatenate(c), pa.int64() if i < 5 else pa.int32()) for i, c in enumerate(out)]

    return scan(only(docs, text), rows, "anchor long, dg long, tk long, tc long, start long, count int")


BODIES = "anchor long, dg long, n long, c int, of struct<anchor:long,dg:long>, at int, body binary"


def finer(a: int, d: int, n: int, body: bytes, unit: Unit, level: int) -> list[tuple]:
    """Rows of BODIES: the parts of a body by anchors of another level, ``at`` where they begin in it.

    c is 2 if the anchor stands at several places of the part, else 1.
    """
    begins = unit.begins(body)
    found, first, count, several = runs_of(body, unit, level)
    keys = mix(found ^ np.uint64(a & (1 << 64) - 1)).view(np.int64)
    parts = [unit.cut(body, begins, f, f + c + unit.window - 1) for f, c in zip(first.tolist(), count.tolist(), strict=True)]
    return [(x, digest(part), n, 1 + s, {"anchor": a, "dg": d}, f, part) for x, f, s, part in zip(keys.tolist(), first.tolist(), several.tolist(), parts, strict=True)]


def fetch(docs: DataFrame, wanted: DataFrame, unit: Unit, text: str) -> DataFrame:
    """Contents (rows of BODIES) of the wanted segments (anchor, dg, n, crowded, tk, tc, start, count).

    Those of crowded anchors come as their parts by finer anchors; ``of`` is null for the others.
    """
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "dg", "n", "crowded", "start", "count")).alias("want"))
    joined = with_key(docs, text).join(per_text, list(KEY)).select("_body", "want")

    def run(batches):
        done: set[tuple[int, int]] = set()  # copies of a text come by as often as the corpus has them
        for batch in batches:
            for raw, want in zip(batch.column("_body"), batch.column("want"), strict=True):
                want = [w for w in want.as_py() if (w["anchor"], w["dg"]) not in done]
                if not want:
                    continue
                if len(done) > 1 << 18:  # only spares repeats
                    done.clear()
                line = unit.line(raw.as_py().encode())
                begins = unit.begins(line)
                out = []
                for w in want:
                    a, d, n = w["anchor"], w["dg"], w["n"]
                    done.add((a, d))
                    body = unit.cut(line, begins, w["start"], w["start"] + w["count"] + unit.window - 1)
                    out += finer(a, d, n, body, unit, 1) if w["crowded"] else [(a, d, n, 1, None, 0, body)]
                yield _batch(out)

    return joined.mapInArrow(run, BODIES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.struct([("anchor", pa.int64()), ("dg", pa.int64())]), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "dg", "n", "c", "of", "at", "body"])


def merged(starts: np.ndarray, window: int) -> list[int]:
    """Starts and ends, in turn, of the stretches that windows at the sorted ``starts`` cover."""
    gap = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + window], axis=1).ravel().tolist()


def indexed(bodies: DataFrame, unit: Unit) -> DataFrame:
    """anchor, dg and ``spans`` (starts and ends in turn) that repeated windows of each body cover, by a shard's own index."""
    dealt = bodies.select("anchor", "dg", "n", "body").repartition("anchor").sortWithinPartitions("anchor", "dg")

    def settle(group: list[tuple[int, int, int, bytes]]):
        found = [(a, d, merged(h, unit.window)) for (a, d, _, _), h in zip(group, unit.repeated([b for *_, b in group], [min(n, 2) for _, _, n, _ in group]), strict=True) if len(h)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["anchor", "dg", "spans"])

    def run(batches):
        group, size = [], 0
        for batch in batches:
            for a, d, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "dg", "n", "body")), strict=True):
                if group and size > unit.index_bytes and a != group[-1][0]:
                    yield from settle(group)
                    group, size = [], 0
                if not group or (a, d) != group[-1][:2]:
                    group.append((a, d, n, body))
                    size += len(body)
        if group:
            yield from settle(group)

    return dealt.mapInArrow(run, "anchor long, dg long, spans array<int>")


def settled(parts: DataFrame, unit: Unit, many: int, level: int) -> DataFrame:
    """anchor, dg and spans of the bodies that ``parts`` (BODIES) belong to, dealt by finer anchors as long as too many contents share one."""
    parts = parts.dropDuplicates(["of", "at", "anchor"])
    again = materialize(parts.groupBy("anchor").agg(F.sum(F.col("n") * F.col("c")).alias("n")).where("n > 1").select("anchor"))
    parts = materialize(parts.join(again, "anchor", "left_semi"))  # finer anchors that occur once hold no repeat
    contents = parts.groupBy("anchor", "dg").agg(F.sum("n").alias("n"), F.any_value("body").alias("body"))
    crowded = materialize(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > many).select("anchor"))
    if level < LEVELS and crowded.limit(1).count():
        def rows(batch: pa.RecordBatch) -> list:
            out = [r for a, d, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "dg", "n", "body")), strict=True) for r in finer(a, d, n, body, unit, level + 1)]
            return _batch(out).columns if out else None

        deeper = materialize(scan(contents.join(crowded, "anchor", "left_semi").select("anchor", "dg", "n", "body"), rows, BODIES))
        found = indexed(contents.join(crowded, "anchor", "left_anti"), unit).unionByName(settled(deeper, unit, many, level + 1))
    else:
        found = indexed(contents, unit)
    back = parts.select("of", "at", "anchor", "dg").join(found, ["anchor", "dg"])
    return back.groupBy("of").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("at")))).alias("spans")).select("of.anchor", "of.dg", "spans")


def repeated_windows(docs: DataFrame, unit: Unit, text: str = "text", many: int = MANY) -> DataFrame:
    """tk, tc and ``found``, a set of (start, spans) of every text with repeated windows.

    Spans are starts and ends in turn, counted from ``start``, of what repeated windows cover.
    """
    again = anchors(docs, unit, text).groupBy("anchor").agg(F.sum("c").alias("n")).where("n > 1").select("anchor")
    rows = materialize(segments(docs, unit, text).join(materialize(again), "anchor", "left_semi"))
    contents = materialize(rows.groupBy("anchor", "dg").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "count")).alias("x")).select("anchor", "dg", "n", "x.*"))
    crowded = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > many).select("anchor", F.lit(True).alias("crowded"))
    bodies = materialize(fetch(docs, contents.join(crowded, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), unit, text))
    spans = indexed(bodies.where("of is null"), unit)
    parts = bodies.where("of is not null")
    if parts.limit(1).count():
        spans = spans.unionByName(settled(parts, unit, many, 1))
    spans = materialize(spans)
    out = materialize(rows.join(spans, ["anchor", "dg"]).groupBy(*KEY).agg(F.collect_set(F.struct("start", "spans")).alias("found")))
    for t in (rows, contents, bodies, spans):
        discard(t)
    return out


def covered(found: list[dict] | None) -> list[tuple[int, int]]:
    """Merged, ordered (start, end) symbols that the repeated windows cover."""
    spans = [(f["start"] + a, f["start"] + b) for f in found or () for a, b in zip(f["spans"][::2], f["spans"][1::2], strict=True)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, unit: Unit, ddl: str, emit: Callable[[bytes, np.ndarray | None, int, list[tuple[int, int]]], tuple], text: str = "text", keep: tuple[str, ...] = ("doc_id",), many: int = MANY) -> DataFrame:
    """``keep`` and what ``emit`` makes of (line, word begins or None, number of symbols, removed spans) of every row.

    Every place of a repeated window is removed, also the first; windows are judged on the input.  Null and empty texts,
    and texts shorter than the window, lose nothing.  Repeated rows repeat each other, so both lose what they share.
    """
    found = repeated_windows(docs, unit, text, many)
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])
    names = [f"_k{i}" for i in range(len(keep))]
    keyed = with_key(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("_text")), "_text", *names)
    joined = keyed.join(found, list(KEY), "left").select(*names, "_body", "found")

    def rows(batch: pa.RecordBatch) -> list:
        made = []
        for raw, hits in zip(batch.column("_body"), batch.column("found"), strict=True):
            line = unit.line(raw.as_py().encode())
            spans = covered(hits.as_py())
            begins = unit.begins(line)
            made.append(emit(line, begins, len(line) if begins is None else len(begins) - 1, spans))
        return [*(batch.column(c) for c in names), *map(list, zip(*made, strict=True))]

    return scan(joined, rows, schema)


def kept(line: bytes, begins: np.ndarray | None, n: int, spans: list[tuple[int, int]]) -> bytes:
    """What is left of the line: the other words joined by one blank, or the other bytes."""
    edges = [0, *(x for s in spans for x in s), n]
    rest = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    if begins is None:
        return b"".join(line[a:b] for a, b in rest)
    return b" ".join(line[begins[a] : begins[b] - 1] for a, b in rest)


#: Production units: 35 words and 200 bytes.
WORDS = Unit(True, 35, 8)
BYTES = Unit(False, 200, 32, 1 << 18)
