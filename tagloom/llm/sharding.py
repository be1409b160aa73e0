"""Balanced label propagation over documents.

Documents that are linked (equal texts, and any links between texts that the caller gives) move towards the shard
where most of their neighbours are, as far as that shard's quota has room or rows change places with others that
want to leave it; documents without links fill what is left, so that sizes end exactly even.  Rounds go on until nothing
moves.  State is a count for each text and shard: copies are never listed by group, and
ranks and running sums are taken in buckets, so neither a common text nor a shard meets in one task.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize

SHARDS = 24
#: Rows for each bucket of ranks, and fewest buckets.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 1024
#: Moves are admitted by gain in so many levels.
LEVELS = 8


def before(df: DataFrame, group: str, bucket: Column, order: list, weight: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of the same ``group`` in lower buckets or earlier in the bucket.

    Only the totals of buckets are put in order for a whole group; rows are ordered within their bucket.
    """
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(group, "_b").agg(F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    within = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, [group, "_b"]).withColumn(name, F.col("_o") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("_b", "_o")


def quotas(n: int, shards: int) -> list[int]:
    """Sizes of the shards: at most one apart, larger ones first."""
    return [n // shards + (j < n % shards) for j in range(shards)]


def taken(placed: DataFrame, shards: int) -> list[int]:
    """Rows that ``placed`` (g, shard, c) puts into each shard; one figure for each shard comes to the driver."""
    got = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.sum("c")).collect()}
    return [int(got.get(j) or 0) for j in range(shards)]


def spread(loose: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """(g, shard, c) that fills the shards' room one after another with the rows of ``loose`` (g, c)."""
    lows = [sum(room[:j]) for j in range(len(room))]
    ranges = F.array(*(F.struct(F.lit(j).alias("shard"), F.lit(a).cast("long").alias("a"), F.lit(a + r).cast("long").alias("z")) for j, (a, r) in enumerate(zip(lows, room, strict=True)) if r > 0))
    if not any(room):
        return loose.select("g", F.lit(0).alias("shard"), "c").limit(0)
    ranked = before(loose.withColumn("_all", F.lit(0)), "_all", F.pmod(F.xxhash64("g"), F.lit(buckets)), ["g"], "c")
    cut = F.least(F.col("before") + F.col("c"), F.col("r.z")) - F.greatest("before", F.col("r.a"))
    return ranked.select("g", "before", "c", F.explode(ranges).alias("r")).select("g", F.col("r.shard").alias("shard"), cut.alias("c")).where("c > 0")


def propagate(groups: DataFrame, total: int, shards: int = SHARDS, links: DataFrame | None = None, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """(g, shard, c): how many of the n rows of each group of ``groups`` (g, n) a shard gets, within quotas of ``total``.

    ``links`` (a, b, w) join groups with a weight; without any, rows pull only those of their own group.
    """
    quota = quotas(total, shards)
    # A group begins in as few shards as hold it with a quarter of each left, from one chosen by hash on; one too large for that, evenly.
    first, piece = F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int"), max(1, quota[-1] * 3 // 4)
    place = f"cast(pmod(_f + j, {shards}) as int) as shard"
    few = F.expr(f"transform(sequence(0L, (n - 1) div {piece}), j -> struct({place}, cast(least({piece}, n - j * {piece}) as long) as c))")
    even = F.expr(f"transform(sequence(0L, {shards - 1}L), j -> struct({place}, cast(n div {shards} + if(j < n % {shards}, 1, 0) as long) as c))")
    parts = F.when(F.col("n") <= piece * shards, few).otherwise(even)
    wanted = groups.withColumn("_f", first).select("g", F.explode(F.filter(parts, lambda x: x["c"] > 0)).alias("x")).select("g", "x.shard", "x.c")
    limit = _literals(quota, "shard")
    ranked = before(wanted, "shard", F.pmod(F.xxhash64("g"), F.lit(buckets)), ["g"], "c")
    placed = materialize(ranked.select("g", "shard", "c", F.greatest(F.lit(0), F.least("c", limit - F.col("before"))).cast("long").alias("in")))
    room = [q - t for q, t in zip(quota, taken(placed.select("g", "shard", F.col("in").alias("c")), shards), strict=True)]
    loose = placed.groupBy("g").agg(F.sum(F.col("c") - F.col("in")).alias("c")).where("c > 0")
    settled = placed.where("in > 0").select("g", "shard", F.col("in").alias("c")).unionByName(spread(loose, room, buckets))
    state = materialize(settled.groupBy("g", "shard").agg(F.sum("c").alias("c")))
    discard(placed)
    best, swap, idle = agreement(state, links), False, 0
    for turn in count():
        room = [q - t for q, t in zip(quota, taken(state, shards), strict=True)]
        moves = materialize(admitted(state, room, links, buckets, turn, swap))
        if moves.limit(1).count():
            change = moves.select("g", F.col("source").alias("shard"), (-F.col("m")).alias("c")).unionByName(moves.select("g", F.col("target").alias("shard"), F.col("m").alias("c")))
            after = materialize(state.unionByName(change).groupBy("g", "shard").agg(F.sum("c").alias("c")).where("c > 0"))
            now = agreement(after, links)
            if now > best:
                discard(moves)
                discard(state)
                state, best, swap, idle = after, now, False, 0
                continue
            discard(after)  # linked groups that only change places
        discard(moves)
        swap, idle = not swap, idle + 1
        if idle == (2 if links is None else 4):  # with links, half of the groups may move at a time
            return state


def agreement(state: DataFrame, links: DataFrame | None) -> float:
    """Weight of the links, and pairs of rows of one group, that lie within a shard; what moves are to increase."""
    within = state.agg(F.coalesce(F.sum(F.col("c").cast("double") * (F.col("c") - 1)), F.lit(0.0))).first()[0] / 2
    if links is not None:
        ends = links.join(state.select(F.col("g").alias("a"), "shard", F.col("c").alias("ca")), "a").join(state.select(F.col("g").alias("b"), "shard", F.col("c").alias("cb")), ["b", "shard"])
        within += ends.agg(F.coalesce(F.sum(F.col("w") * F.col("ca") * F.col("cb")), F.lit(0.0))).first()[0]
    return within


def allowance(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from shard to shard of those that want to, so that no shard takes more than its room and what leaves it."""
    left, room, out = {k: n for k, n in flows.items() if n > 0}, list(room), {k: 0 for k in flows}

    def grant(edges: list[tuple[int, int]], n: int) -> None:
        for e in edges:
            out[e] += n
            left[e] -= n
            if not left[e]:
                del left[e]

    while ready := next((e for e in left if room[e[1]] > 0), None):  # into free room, which frees room elsewhere
        n = min(room[ready[1]], left[ready])
        room[ready[1]] -= n
        room[ready[0]] += n
        grant([ready], n)
    while ring := _ring(left):
        grant(ring, min(left[e] for e in ring))
    return out


def _ring(edges: dict[tuple[int, int], int]) -> list[tuple[int, int]] | None:
    """Edges of a way that comes back to where it begins."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(edges):
        after.setdefault(a, []).append(b)
    dead: set[int] = set()
    for start in after:
        way = [start]
        while way:
            onward = next((b for b in after.get(way[-1], ()) if b not in dead), None)
            if onward is None:
                dead.add(way.pop())
            elif onward in way:
                way = [*way[way.index(onward) :], onward]
                return list(zip(way, way[1:], strict=False))
            else:
                way.append(onward)
    return None


def admitted(state: DataFrame, room: list[int], links: DataFrame | None, buckets: int, turn: int = 0, swap: bool = False) -> DataFrame:
    """(g, source, target, m): moves of m rows to the shard where the most neighbours are, larger gains first.

    Rows go to the best shard that has room, or with ``swap`` to the best of all, where they change places with rows
    that want to go the other way or round a ring of shards; how many want to go from each shard to each other comes
    to the driver.
    """
    votes = state.select("g", "shard", F.col("c").cast("double").alias("v"))
    if links is not None:
        both = links.select(F.col("a").alias("g"), F.col("b").alias("h"), "w").unionByName(links.select(F.col("b").alias("g"), F.col("a").alias("h"), "w"))
        theirs = both.join(state.select(F.col("g").alias("h"), "shard", "c"), "h").groupBy("g", "shard").agg(F.sum(F.col("w") * F.col("c")).alias("v"))
        votes = votes.unionByName(theirs).groupBy("g", "shard").agg(F.sum("v").alias("v"))
    # ties go by a hash of group and shard, so that groups don't all lean to one shard and nothing moves to and fro
    votes = votes.withColumn("k", F.xxhash64("g", "shard"))
    best = (votes if swap else votes.where(_literals(room, "shard") > 0)).groupBy("g").agg(F.max(F.struct("v", "k", "shard")).alias("x")).select("g", F.col("x.shard").alias("target"), F.col("x.v").alias("top"), F.col("x.k").alias("tk"))
    held = state.join(votes, ["g", "shard"]).join(best, "g")
    if links is None:
        held = held.where("target <> shard and (v < top or v = top and k < tk)")
    else:  # a row is no neighbour of its own; half of the groups move at a time, lest linked ones change places
        held = held.where("target <> shard and v - 1 < top").where(F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(2)) == 0)
    level = F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.col("top") - F.col("v") + 1))).cast("long")
    shards = len(room)
    held = materialize(held.withColumn("pair", F.col("shard") * shards + F.col("target")))
    wish = {divmod(r[0], shards): r[1] for r in held.groupBy("pair").agg(F.sum("c")).collect()}
    allowed = allowance(wish, room)
    place = (F.lit(LEVELS - 1) - level) * buckets + F.pmod(F.xxhash64("g"), F.lit(buckets))
    ranked = before(held.select("g", "shard", "target", "pair", "c", "v", "top"), "pair", place, ["g", "shard"], "c")
    m = F.greatest(F.lit(0), F.least("c", _literals([allowed.get(divmod(p, shards), 0) for p in range(shards * shards)], "pair") - F.col("before"))).cast("long")
    return ranked.select("g", F.col("shard").alias("source"), "target", m.alias("m")).where("m > 0")


def _literals(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)).cast("long") for v in values)), F.col(index) + 1)


def shard(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row, under the law of even row counts.

    Size is the number of UTF-8 bytes plus 8; slots of a shard run from 0 without gaps.  ``links`` may join texts by
    their MD5 (a, b, w).  Null texts have no bytes and belong together with empty ones; repeated rows each get a slot
    of their own; an empty table gives an empty one; other columns are left out.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("g")))
    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    counted = rows.groupBy("g").agg(F.count("*").alias("n"))
    tied = counted.where("n > 1")
    if links is not None:
        ends = links.select(F.col("a").alias("g")).unionByName(links.select(F.col("b").alias("g"))).distinct()
        tied = tied.unionByName(counted.where("n = 1").join(ends, "g", "left_semi"))
    tied = materialize(tied)
    state = propagate(tied, total, shards, links, buckets)
    left = [q - t for q, t in zip(quotas(total, shards), taken(state, shards), strict=True)]
    fill = rows.sparkSession.range(1).select(F.lit("").alias("g"), F.explode(F.array(*(F.struct(F.lit(j).alias("shard"), F.lit(n).cast("long").alias("c")) for j, n in enumerate(left)))).alias("x")).select("g", "x.shard", "x.c").where("c > 0")
    state = materialize(before(state.unionByName(fill), "shard", F.pmod(F.xxhash64("g"), F.lit(buckets)), ["g"], "c", "base"))
    # ranges of ranks within a group, at most one for each shard
    upto = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = state.withColumn("lo", F.coalesce(F.sum("c").over(upto), F.lit(0))).groupBy("g").agg(F.collect_list(F.struct("lo", "c", "shard", "base")).alias("ranges"))
    # rows without links form the group without a name
    keyed = rows.join(tied.select("g", F.lit(True).alias("_tied")), "g", "left").withColumn("g", F.when(F.col("_tied"), F.col("g")).otherwise("")).withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))).drop("_tied")
    keyed = materialize(keyed)
    counts = keyed.groupBy("g", "b").agg(F.count("*").alias("n"))
    starts = counts.select("g", "b", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    plan = starts.join(ranges, "g").select("g", "b", "o", "ranges")
    rank = F.col("o") + F.row_number().over(Window.partitionBy("g", "b").orderBy("doc_id", "text_crc32", "size")) - 1
    found = keyed.join(plan, ["g", "b"]).withColumn("r", rank).withColumn("x", F.expr("filter(ranges, p -> r >= p.lo and r < p.lo + p.c)[0]"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("x.shard").cast("int").alias("shard"), (F.col("x.base") + F.col("r") - F.col("x.lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
