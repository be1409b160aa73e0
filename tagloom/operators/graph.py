"""Expansion of query terms over a weighted tag graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.sources.workspace import settle

#: Weights of edge types, the least weight that goes on, and the bound of nodes after which the queue mode
#: stops.  Expansion goes on until nothing improves; more rounds than HOPS are an error, since only weights above 1 can
#: grow for so long.
TYPE_WEIGHTS = {"self": 1.0, "KG": 0.2, "coocc": 0.2, "KGm": 0.7, "KGi": 0.15}
PRUNE = 0.05
HOPS = 1000
QUEUE = 100


def type_weight(weights: dict[str, float] | None = None) -> Column:
    """Weight of the column ``tp``, 0 for unknown types."""
    out = F.lit(0.0)
    for tp, w in (TYPE_WEIGHTS if weights is None else weights).items():
        out = F.when(F.col("tp") == tp, F.lit(float(w))).otherwise(out)
    return out


def expand(seeds: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None, hops: int = HOPS, mode: str = "exact") -> DataFrame:
    """qid, seed, node, w, path (node, type, node ...) of all that seeds (qid, seed) reach over edges (tp, u, v, w).

    A node's weight is the largest product of edge and type weights over ways to it, 1 at most and ``PRUNE`` at least;
    the seed itself has 1.  Only nodes that have improved go on in the next round.  Of equal ways the smaller path
    holds.  The mode 'fifo' keeps the order of a queue and its bound instead.
    """
    if mode == "fifo":
        return _expand_fifo(seeds, edges, weights, hops)
    step = edges.select("tp", "u", "v", (F.col("w") * type_weight(weights)).alias("f")).where("f > 0")
    start = seeds.select("qid", "seed").distinct().select("qid", "seed", F.col("seed").alias("node"), F.lit(1.0).alias("w"), F.array(F.col("seed")).alias("path"))
    known = settle(start)
    front = known
    for _ in range(hops):
        moved = front.join(step, F.col("node") == F.col("u")).where(F.col("w") * F.col("f") >= PRUNE - 1e-12).select("qid", "seed", F.col("v").alias("node"), (F.col("w") * F.col("f")).alias("w"), F.concat("path", F.array("tp", "v")).alias("path"))
        best = moved.groupBy("qid", "seed", "node").agg(F.min(F.struct((-F.col("w")).alias("k"), "path")).alias("x")).select("qid", "seed", "node", (-F.col("x.k")).alias("w"), "x.path")
        better = best.join(known.select("qid", "seed", "node", F.col("w").alias("old")), ["qid", "seed", "node"], "left").where("old is null or w > old + 1e-12").drop("old")
        front = settle(better)
        if not front.limit(1).count():
            break
        known = settle(known.join(front.select("qid", "seed", "node"), ["qid", "seed", "node"], "left_anti").unionByName(front))
    else:
        raise ValueError(f"weights still grow after {hops} rounds")
    return known.withColumn("w", F.least("w", F.lit(1.0)))


def _expand_fifo(seeds: DataFrame, edges: DataFrame, weights: dict[str, float] | None, hops: int) -> DataFrame:
    """One queue per seed over the edges that it can reach at all, which the exact mode finds first."""
    reach = expand(seeds, edges, weights, hops).select("qid", "seed", F.col("node").alias("u"))
    near = reach.join(edges.select("tp", "u", "v", (F.col("w") * type_weight(weights)).alias("f")), "u").where("f > 0")
    rows = near.select("qid", "seed", "u", "v", "tp", "f").unionByName(seeds.select("qid", "seed", F.col("seed").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("string").alias("tp"), F.lit(0.0).alias("f")).distinct())

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        seed = key[1]
        out: dict[str, list] = {}
        for r in frame.dropna(subset=["v"]).sort_values(["u", "tp", "v"]).itertuples():
            out.setdefault(r.u, []).append((r.tp, r.v, r.f))
        best, path, queue, head = {seed: 1.0}, {seed: [seed]}, [seed], 0
        while head < len(queue) < QUEUE:
            node = queue[head]
            head += 1
            for tp, v, f in out.get(node, ()):
                w = best[node] * f
                if w < PRUNE:
                    continue
                if v not in best:
                    queue.append(v)
                if w > best.get(v, 0.0):
                    best[v], path[v] = w, [*path[node], tp, v]
        return pd.DataFrame({"qid": key[0], "seed": seed, "node": list(best), "w": [min(w, 1.0) for w in best.values()], "path": [path[n] for n in best]})

    schema = seeds.select("qid", "seed").withColumn("node", F.lit("")).withColumn("w", F.lit(1.0)).withColumn("path", F.array(F.lit(""))).schema
    return rows.groupBy("qid", "seed").applyInPandas(run, schema)


def merge_seeds(expanded: DataFrame) -> DataFrame:
    """qid, node and weight over all seeds: halfway between the largest and the sum."""
    return expanded.groupBy("qid", "node").agg(((F.max("w") + F.sum("w")) * 0.5).alias("weight"))


def known_nodes(terms: DataFrame, nodes: DataFrame, column: str = "term") -> DataFrame:
    """Rows whose term is a node."""
    return terms.join(nodes.select(F.col("node").alias(column)).distinct(), column, "left_semi")


def query_weights(terms: DataFrame, nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """qid, term and weight: what the seeds reach, and 0.5 for every occurrence of a term that isn't a node."""
    words = terms.join(nodes.select(F.col("node").alias("term")).distinct(), "term", "left_anti").groupBy("qid", "term").agg((F.count("*") * 0.5).alias("weight"))
    both = merge_seeds(expanded).select("qid", F.col("node").alias("term"), "weight").unionByName(words)
    return both.groupBy("qid", "term").agg(F.sum("weight").alias("weight"))


def explain(weights: DataFrame, expanded: DataFrame, top: int = 10, least: float = 0.1) -> DataFrame:
    """qid, path, end and w of ways to the ``top`` heaviest terms that weigh over ``least`` and have an edge."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("weight", 6).desc(), "term"))
    ends = weights.withColumn("_r", rank).where(F.col("_r") <= top).select("qid", F.col("term").alias("node"))
    found = expanded.join(ends, ["qid", "node"]).where((F.col("w") > least) & (F.size("path") > 1))
    return found.select("qid", "path", F.col("node").alias("end"), "w")
