"""TextRank over the lines of documents against plain ranks."""

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from tagloom.operators import phrases
from tagloom.plans import mining  # noqa: F401
from tagloom.plans.registry import QUERIES


def plain(words):
    w = Counter()
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 5]:
            if a != b:
                w[a, b] += 1
                w[b, a] += 1
    total = defaultdict(int)
    for (a, _), n in w.items():
        total[a] += n
    ranks = dict.fromkeys(total, 1.0)
    for _ in range(10):
        ranks = {t: 0.15 + 0.85 * sum(n / total[a] * ranks[a] for (a, b), n in w.items() if b == t) for t in ranks}
    return ranks


def test_lines_of_documents_are_ranked(spark, tmp_path):
    texts = ["one two three one four\n\nalone\nsame same same\nOne two three one four", "b a b c a d e f g a b c\nx y", None, ""]
    pd.DataFrame({"doc_id": range(4), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = {(r.doc_id, r.line, r.token): r.weight for r in QUERIES["textrank"](spark, str(tmp_path)).collect()}
    wanted = {(d, i, t): w for d, text in enumerate(texts) for i, x in enumerate((text or "").split("\n")) for t, w in plain(x.lower().split()).items()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 2e-6 for k in got)


def test_long_lines_are_ranked(spark):
    words = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(200_000).cast("long")), lambda i: F.concat(F.lit("w"), (i * i % 70_001).cast("string")))
    got = phrases.text_rank(spark.range(1).select(F.col("id").alias("sentence"), words.alias("tokens")))
    assert got.count() == len({i * i % 70_001 for i in range(1, 200_001)})
