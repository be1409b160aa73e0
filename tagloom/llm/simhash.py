"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in at most r of 64 bits agree wholly in b - r of any b blocks, so a key for each choice of
blocks brings all candidates together.  The Hamming distances of every fingerprint to reference fingerprints (pivots)
are computed once and travel with it: by the triangle inequality, close fingerprints have distances to any pivot that
differ by at most r, so pairs whose coordinates differ more are discarded, and survivors are verified bit by bit.  Only
the links of a spanning forest leave a task.

For a similarity such as 0.8 the radius is too wide for blocks.  Then fingerprints have 256 bits over the set of
shingles, and candidates share a band of least hashes; pivots and fingerprints tell most of them off, and the others
are gathered in loose components.  Within those, pairs are linked by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import discard, materialize, only, scan, texts
from tagloom.llm.components import components
from tagloom.llm.windows import mix

WORDS = 4
SEED = 42
RADIUS = 4
#: 64-bit parts of a wide fingerprint.
WIDE = 4
#: Bands of least hashes and hashes in each: a pair at 0.8 shares one with probability 1 - (1 - 0.8 ** 6) ** 20 = 0.998.
BANDS, ROWS = 20, 6
#: Standard deviations that a distance may lie above the one to be expected of a pair of just the wanted similarity.
SPREAD = 5
#: Reference fingerprints: fixed pseudo-random ones.  Their distances fill two longs, a byte each.
PIVOTS = np.random.default_rng(5).integers(0, 2**64, (16, WIDE), dtype=np.uint64)
TABLE = ("t0", "t1")
#: Odd multipliers that turn a shingle's hash into the hashes for the further parts, and for the bands.
_PARTS = np.random.default_rng(11).integers(0, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEAST = np.random.default_rng(17).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Keys with more fingerprints than this are split by ranges of pivot distances, by so many pivots at most.
CROWD, SPLITS = 4096, 8
#: Groups of up to this many fingerprints are worked off together, larger ones one by one; both find the same links.
TOGETHER = 48
#: Bytes of text of a loose component that one task compares; larger components go in pairs of blocks.
BLOCK_BYTES = 8 << 20


def shingles(text: str, size: int) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words, repeats included; A-Z count as a-z.

    A text of fewer words is one shingle; without words there is none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    size = min(size, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.r_[0, ends[:-1]][: len(found) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str, size: int = WORDS) -> int:
    """SimHash of 64 bits over the shingles; zero without words."""
    return majority(shingles(text, size))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes())


def wide_fingerprint(kinds: np.ndarray) -> list[int]:
    """Parts of a fingerprint over different shingles."""
    return [majority(kinds if i == 0 else mix(kinds * _PARTS[i])) for i in range(WIDE)]


def bands(kinds: np.ndarray) -> np.ndarray:
    """A hash of the least hashes of each band, as signed numbers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(kinds), 1024):
        least = np.minimum(least, (kinds[at : at + 1024, None] * _LEAST).min(axis=0))
    rolled = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + column)
    return rolled.view(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distances(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of fingerprints; either may be one row."""
    return np.bitwise_count(f ^ x).sum(axis=-1, dtype=np.int16)


def pivot_table(f: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the pivots, a row for each fingerprint; those of wide ones are halved, so that a byte holds them."""
    return (np.stack([distances(f, p[: f.shape[1]]) for p in PIVOTS], axis=1) >> (f.shape[1] > 1)).astype(np.uint8)


def table_limit(radius: int, parts: int) -> int:
    """How far the coordinates of fingerprints within ``radius`` may differ."""
    return radius if parts == 1 else (radius + 1) // 2


def fingerprints(docs: DataFrame, size: int = WORDS, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, fp (the fingerprint as a signed long) and its pivot distances; null texts count as empty."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL("fp long, t0 long, t1 long").fields])

    def rows(batch: pa.RecordBatch) -> list:
        made = np.array([fingerprint(t, size) for t in texts(batch, text)], np.uint64)
        return [*(batch.column(c) for c in keep), made.view(np.int64), *pivot_table(made[:, None]).view(np.int64).T]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema)


def sketches(docs: DataFrame, size: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, fp (a hash of the set of shingles), the parts of its wide fingerprint, pivot distances and keys of bands."""
    parts = ", ".join(f"p{i} long" for i in range(WIDE))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(f"fp long, {parts}, t0 long, t1 long, keys array<long>").fields])

    def rows(batch: pa.RecordBatch) -> list:
        sets = [np.unique(shingles(t, size)) for t in texts(batch, text)]
        wide = np.array([wide_fingerprint(s) for s in sets], np.uint64)
        keys = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, np.concatenate([bands(s) for s in sets]))
        return [*(batch.column(c) for c in keep), [signed(xxhash.xxh3_64_intdigest(s.tobytes())) for s in sets], *np.ascontiguousarray(wide.T).view(np.int64), *np.ascontiguousarray(pivot_table(wide).view(np.int64).T), keys]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` among ``blocks`` nearly equal blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def choose_blocks(n: int, radius: int) -> int:
    """Fewest blocks with which n evenly spread fingerprints put at most four under one key; any number is exact."""
    return next(b for b in range(radius + 1, 65) if n / 2.0 ** (64 * (b - radius) / b) <= 4 or b == 16)


def bit_distance(similarity: float) -> float:
    """Share of bits in which SimHashes of two equally large sets of this Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float) -> int:
    """Distance of wide fingerprints that hardly any pair of at least this similarity exceeds."""
    share, bits = bit_distance(similarity), 64 * WIDE
    return math.ceil(share * bits + SPREAD * math.sqrt(bits * share * (1 - share)))


def links(nodes: DataFrame, keys: Column, parts: list[str], radius: int, loose: bool = False, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of nodes (fp, ``parts``, pivot distances) within ``radius`` bits that share a key, enough to connect all of these.

    ``keys`` is an array of longs.  Not every link is named, but within a key two nodes are connected through the
    result exactly if they are through links.  Keys of one node go no further.  Crowded keys are split by ranges of
    pivot distances that overlap by the radius, which parts no link; if ``loose``, all of their nodes are connected.
    """
    keyed = nodes.select("fp", F.explode(keys).alias("key"))
    met = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where("n > 1"))
    shared = keyed.join(met, "key")
    width = table_limit(radius, len(parts)) + 1
    split = F.array("key")
    for i in range(SPLITS):  # each pivot sends a node to the range of its distance and to the one below
        cell = F.floor(F.shiftrightunsigned(F.col(TABLE[i // 8]), 8 * (i % 8)).bitwiseAND(F.lit(255)) / width)
        finer = F.flatten(F.transform(split, lambda k: F.array(F.xxhash64(k, cell), F.xxhash64(k, cell - 1))))  # noqa: B023
        split = F.when(F.col("n") > crowd * 2**i, finer).otherwise(split)
    dealt = (shared.where(F.col("n") <= crowd) if loose else shared).join(nodes.select("fp", *parts, *TABLE), "fp")
    if not loose:
        dealt = dealt.withColumn("key", F.explode(split))
    dealt = dealt.select("key", "fp", *parts, *TABLE).repartition("key").sortWithinPartitions("key")

    def run(batches):
        key, rest, known = None, [], set()
        for batch in batches:
            k = batch.column("key").to_numpy()
            f = np.stack([batch.column(c).to_numpy() for c in ("fp", *parts, *TABLE)], axis=1).view(np.uint64)
            if not len(k):
                continue
            cuts = np.flatnonzero(np.diff(k)) + 1
            if key is not None and k[0] != key:
                yield from out(np.concatenate(rest), np.zeros(1, np.int64), known)
                rest = []
            tail = cuts[-1] if len(cuts) else 0
            if tail:
                head = np.concatenate([*rest, f[:tail]])
                yield from out(head, np.r_[0, cuts[:-1] + len(head) - tail], known)
                rest = []
            rest.append(f[tail:])
            key = k[-1]
        if rest:
            yield from out(np.concatenate(rest), np.zeros(1, np.int64), known)

    def out(f, starts, known):
        table = np.ascontiguousarray(f[:, len(parts) + 1 :]).view(np.uint8)
        a, b = near_pairs(np.ascontiguousarray(f[:, 1 : len(parts) + 1]), starts, radius, table)
        ids = np.ascontiguousarray(f[:, 0]).view(np.int64)
        fresh = {(x, y) if x < y else (y, x) for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True) if x != y} - known
        if len(known) > 1 << 18:  # only spares repeats within a task
            known.clear()
        known.update(fresh)
        if fresh:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in fresh], pa.int64()) for i in (0, 1)], names=["a", "b"])

    found = dealt.mapInArrow(run, "a long, b long")
    if loose:
        found = found.unionByName(shared.where((F.col("n") > crowd) & (F.col("fp") != F.col("first"))).select(F.col("first").alias("a"), F.col("fp").alias("b")))
    return found.distinct()


def within(table: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of rows whose pivot distances differ by at most ``limit`` in every coordinate."""
    for c in range(0, table.shape[1], 4):  # a few coordinates at a time: most pairs fall at the first ones
        keep = np.abs(table[a, c : c + 4].astype(np.int16) - table[b, c : c + 4]).max(axis=1, initial=0) <= limit
        a, b = a[keep], b[keep]
    return a, b


def near_pairs(f: np.ndarray, starts: np.ndarray, radius: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links within the groups that begin at ``starts``, enough to connect what is linked in each."""
    table = pivot_table(f) if table is None else table
    limit = table_limit(radius, f.shape[1])
    sizes = np.diff(np.r_[starts, len(f)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(2, min(TOGETHER, int(sizes.max(initial=0))) + 1):
        at = starts[sizes == s]
        if len(at):
            i, j = np.triu_indices(s, 1)
            for part in np.array_split(at, 1 + len(at) * len(i) // (1 << 17)):
                a, b = within(table, (part[:, None] + i).ravel(), (part[:, None] + j).ravel(), limit)
                close = distances(f[a], f[b]) <= radius
                left.append(a[close])
                right.append(b[close])
    for g in np.flatnonzero(sizes > TOGETHER):
        rows = slice(starts[g], starts[g] + sizes[g])
        own, t = f[rows], table[rows]
        a, b = peel(len(own), lambda x, rest: _near(own, t, x, rest, radius, limit))  # noqa: B023
        left.append(a + starts[g])
        right.append(b + starts[g])
    return np.concatenate(left), np.concatenate(right)


def _near(f: np.ndarray, table: np.ndarray, x: int, rest: np.ndarray, radius: int, limit: int) -> np.ndarray:
    maybe = within(table, rest, np.full(len(rest), x), limit)[0]
    return maybe[distances(f[maybe], f[x]) <= radius]


def peel(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a spanning forest of the links among n rows: what is linked to a row leaves the others at once.

    ``near`` gives, of a row and an array of others, those that are linked to it.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rest = np.arange(n)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            if len(hit):
                left.append(np.full(len(hit), x))
                right.append(hit)
                queue += hit.tolist()
                rest = rest[~np.isin(rest, hit)]
    return np.concatenate(left), np.concatenate(right)


def similar_pairs(sets: list[np.ndarray], f: np.ndarray, similarity: float, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links, enough to connect all sets whose Jaccard similarity is ``similarity`` or more.

    Pairs that pivots, fingerprints or sizes tell off aren't compared.
    """
    table, radius = pivot_table(f) if table is None else table, wide_radius(similarity)
    limit, sizes = table_limit(radius, f.shape[1]), np.array([len(s) for s in sets])

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        rest = rest[np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x]) - 1e-9]
        rest = _near(f, table, x, rest, radius, limit)
        if not len(rest) or not sizes[x]:
            return rest
        common = []
        for part in np.array_split(rest, 1 + int(sizes[rest].sum()) // (1 << 20)):
            other = np.concatenate([sets[y] for y in part])
            at = np.minimum(np.searchsorted(sets[x], other), sizes[x] - 1)
            common.append(np.add.reduceat(sets[x][at] == other, np.cumsum(np.r_[0, sizes[part][:-1]]), dtype=np.int64))
        both = np.concatenate(common)
        return rest[both >= similarity * (sizes[rest] + sizes[x] - both) - 1e-9]

    return peel(len(sets), near)


def verified(nodes: DataFrame, loose: DataFrame, bodies: DataFrame, size: int, similarity: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) by exact similarity within the loose components (node, root), enough to connect what is linked.

    ``nodes`` has fp, row, bytes, parts and pivot distances, ``bodies`` row and text.  Components of more bytes than a
    block are cut into blocks by hash, and each pair of blocks is one group, so no task holds more than two blocks.
    """
    parts = [f"p{i}" for i in range(WIDE)]
    members = loose.join(nodes.select(F.col("fp").alias("node"), "row", "bytes", *parts, *TABLE), "node")
    blocks = loose.join(nodes.select(F.col("fp").alias("node"), "bytes"), "node").groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    mates = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own")))
    dealt = members.join(blocks, "root").withColumn("own", own).withColumn("mate", F.explode(mates))
    dealt = dealt.select("root", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), "node", "row", *parts, *TABLE)
    group = ["root", "i", "j"]
    full = dealt.join(bodies, "row").drop("row").repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        key, ids, sets, table = None, [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*group, "node")]
            numbers = np.stack([batch.column(c).to_numpy() for c in (*parts, *TABLE)], axis=1)
            for at, (root, i, j, node) in enumerate(zip(*columns, strict=True)):
                if key != (root, i, j):
                    yield from out(ids, sets, table)
                    key, ids, sets, table = (root, i, j), [], [], []
                ids.append(node)
                sets.append(np.unique(shingles(batch.column("text")[at].as_py() or "", size)))
                table.append(numbers[at])
        yield from out(ids, sets, table)

    def out(ids, sets, table):
        if len(ids) > 1:
            numbers = np.stack(table).view(np.uint64)
            a, b = similar_pairs(sets, np.ascontiguousarray(numbers[:, :WIDE]), similarity, np.ascontiguousarray(numbers[:, WIDE:]).view(np.uint8))
            if len(a):
                nodes_ = np.array(ids)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_[a]), pa.array(nodes_[b])], names=["a", "b"])

    return full.mapInArrow(run, "a long, b long").distinct()


def similar_roots(bodies: DataFrame, rows: DataFrame, size: int, similarity: float, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, root) of the nodes that are linked to another one; ``rows`` has row, bytes and what :func:`sketches` gives."""
    parts = [f"p{i}" for i in range(WIDE)]
    rest = [*parts, *TABLE, "keys"]
    nodes = materialize(rows.groupBy("fp").agg(F.min("row").alias("row"), F.max("bytes").alias("bytes"), *(F.first(c).alias(c) for c in rest)))
    loose = materialize(components(links(nodes, F.col("keys"), parts, wide_radius(similarity), True, crowd)))
    roots = materialize(components(verified(nodes, loose, bodies, size, similarity, block_bytes)))
    discard(nodes)
    discard(loose)
    return roots


ROW = "__tagloom_row"


def _described(docs: DataFrame, size: int, similarity: float, text: str, **limits) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a number for each row, kept in the shared folder, and row, doc_id, body (a hash of the text), fp and root of each."""
    base = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bodies = base.select(F.col(ROW).alias("row"), "doc_id", body.alias("text"), F.octet_length(body).cast("long").alias("bytes"), F.xxhash64(body).alias("body"))
    rows = materialize(sketches(bodies, size, "text", ("row", "doc_id", "bytes", "body")))
    roots = similar_roots(bodies.select("row", "text"), rows, size, similarity, **limits)
    return base, rows.select("row", "doc_id", "body", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = WORDS, radius: int = RADIUS, similarity: float | None = None, text: str = "text", blocks: int | None = None, **limits) -> DataFrame:
    """doc_id, fp (signed long), component_id and root of every row.

    Fingerprints of 64 bits are linked at ``radius`` differing bits at most, all of them; with ``similarity``, texts
    whose sets of shingles have that Jaccard similarity, of which BANDS and ROWS find all but few at the limit and
    none below it.  component_id is the smallest doc_id that can be reached over links, null where a component has no
    id at all; root is its smallest fp.  Equal texts share a fingerprint, so groups of copies are one node however
    large.  Null and empty texts have no shingle, and are linked like any other.  Texts are taken whole, however long.
    Other columns are left out; an empty table gives an empty one.
    """
    if similarity is not None:
        rows = materialize(_described(docs, size, similarity, text, **limits)[1])
        smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return rows.join(smallest, "root").select("doc_id", "fp", "component_id", "root")
    rows = materialize(fingerprints(docs, size, text))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in TABLE)))
    masks = block_masks(blocks or choose_blocks(nodes.count(), radius), radius)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)))
    roots = materialize(components(links(nodes.withColumn("p0", F.col("fp")), keys, ["p0"], radius, **limits)))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(smallest, "root").select("fp", "component_id", "root"))
    discard(nodes)
    discard(roots)
    return rows.select("doc_id", "fp").join(classes, "fp", "left").select("doc_id", "fp", "component_id", "root")


def hex_digits(fp):
    """16 lower-case hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, size: int, similarity: float, text: str = "text", **limits) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, and all columns.

    It is the row of the smallest doc_id, ids before null, and of rows with one id that of the smaller hash of its
    text; repeated rows count as one.  Rows of one id whose texts aren't alike both stay.  Null and empty texts are
    alike.  An empty table gives an empty one.
    """
    base, rows = _described(docs, size, similarity, text, **limits)
    rows = materialize(rows)
    best = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "body", "row")).alias("x")).where("n > 1")
    gone = materialize(rows.join(best, "root").where("row <> x.row").select(F.col("row").alias(ROW)))
    discard(rows)
    return base.join(gone, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
