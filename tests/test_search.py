"""Search over every benchmark item against brute force on a small fixture."""

import math
import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.operators import index, search
from tagloom.plans.registry import QUERIES
from tagloom.plans import retrieval  # noqa: F401


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """14 items and 30 documents; each item's first two words stand in the document of its number."""
    at, rng = tmp_path_factory.mktemp("small"), random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    items = [f"{rng.choice(vocab)} q{'abcdefghijklmn'[i]} " + " ".join(rng.choices(vocab, k=5)) for i in range(14)]
    docs = [" ".join(rng.choices(vocab, k=rng.randint(5, 40))) + (" " + " ".join(items[d].split()[:2]) if d < 14 else "") for d in range(30)]
    pd.DataFrame({"doc_id": range(30), "text": docs}).to_parquet(at / "documents.parquet")
    pd.DataFrame({"item_id": range(14), "text": items}).to_parquet(at / "benchmark.parquet")
    return str(at), docs, items


def hits(text, entries):
    units = re.findall("[0-9a-z]+|[^0-9a-z]", text)
    return [s for i in range(len(units)) for k in (1, 3) if i + k <= len(units) and (s := "".join(units[i : i + k])) in entries]


def brute(docs, items):
    """(levels, hits) of all items."""
    words = [re.findall("[a-z]+", d) for d in docs]
    total = Counter(w for d in words for w in d)
    common = [w for w, _ in sorted(((w, c) for w, c in total.items() if len(w) >= 3), key=lambda x: (-x[1], x[0]))]
    nodes, entries = set(common[:200]), set(common[:30]) | {" ".join(t.split()[:2]) for t in items}
    pairs = Counter((u, v) for d in words for u, v in zip(d, d[1:]) if u != v and u in nodes and v in nodes)
    edges = defaultdict(list)
    for (u, v), n in pairs.items():
        if n / total[u] >= 0.03:
            edges[u].append((v, n / total[u] * 0.7))
    tf = [Counter(w + hits(re.sub(" +", " ", d.lower()), entries)) for w, d in zip(words, docs)]
    dl = [sum(c.values()) for c in tf]
    df = Counter(t for c in tf for t in c)
    idf = {t: math.log(max((len(docs) - n + 0.5) / (n + 0.5), 1.0001)) for t, n in df.items()}
    avgdl, levels, found = sum(dl) / len(dl), {}, {}
    for q, text in enumerate(items):
        terms = re.findall("[a-z]+", text) + sorted(set(hits(text, entries)))
        ways, weight = defaultdict(list), Counter()
        for seed in set(terms) & nodes:
            best, front = {seed: 1.0}, [seed]
            while front:
                u = front.pop()
                for v, f in edges[u]:
                    if best[u] * f >= 0.05 - 1e-12 and best[u] * f > best.get(v, 0) + 1e-12:
                        best[v] = best[u] * f
                        front.append(v)
            for v, w in best.items():
                ways[v].append(w)
        for v, w in ways.items():
            weight[v] += (max(w) + sum(w)) / 2
        for t in terms:
            weight[t] += 0 if t in nodes else 0.5
        for t, w in weight.items():
            if t in idf and w:
                levels[q, t] = math.floor(min(max(w * idf[t] * 0.25, 0), 1) * 200 + 55 + 1e-9)
        score = {d: sum(w * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.7 + 0.3 * dl[d] / avgdl)) for t, w in weight.items() if c[t]) for d, c in enumerate(tf)}
        score = {d: s for d, s in score.items() if any(tf[d][t] for t, w in weight.items() if w)}
        for rank, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 6), d))[:20], 1):
            found[q, d] = (rank, score[d])
    assert any(t in idf and " " in t for _, t in levels)  # two-word hits meet postings
    return levels, found


def test_every_item_is_searched(spark, small):
    at, docs, items = small
    levels, found = brute(docs, items)
    got = {(r.qid, r.doc_id): (r["rank"], r.score) for r in QUERIES["kg_search_all"](spark, at).collect()}
    assert {q for q, _ in got} == set(range(14)) and got.keys() == found.keys()
    assert all(got[k][0] == found[k][0] and abs(got[k][1] - found[k][1]) < 1e-3 for k in found)
    assert {(r.qid, r.term): r.level for r in QUERIES["highlight_levels_all"](spark, at).collect()} == levels
    assert {r.qid for r in QUERIES["best_paths"](spark, at).select("qid").collect()} - set(range(10))
    assert {r.qid for r in QUERIES["render_results"](spark, at).collect()} == set(range(14))


def test_common_terms_are_read_whole(spark):
    """A term in more documents than the read cap of the reference."""
    n = index.READ_CAP + 50
    tf = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("term"), F.lit(1).cast("long").alias("tf"))
    empty = spark.createDataFrame([], "node string, surface string, weight long, tp string, u string, v string, w double")
    asked = spark.createDataFrame([(1, "x")], "qid int, text string")
    found = search.search(asked, empty.select("surface", "weight"), empty.select("node"), empty.select("tp", "u", "v", "w"), index.build(tf), retrieval.fn.words, limit=2 * n)
    assert found.hits.count() == n
