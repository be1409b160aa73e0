"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b): root is the smallest node of its component.

    In turn, each node's larger and smaller neighbours are linked to the smallest one, until nothing changes; the
    number of rounds grows with the logarithm of the longest chain.  Neighbours are never gathered per node: minima are
    aggregated before the shuffle and joined back, and the join splits nodes with very many links.  Loops and repeated
    edges do no harm; an empty table gives an empty one.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pairs)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(now)
        discard(large)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(pairs: DataFrame) -> tuple:
    """Number of pairs and a sum of their hashes; equal for equal sets of pairs."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
