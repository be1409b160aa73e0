"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= g) = s(threshold_g - w.x) with one weight vector for all thresholds, which rise with the grade.  Features
are 1 + log of the counts of words and word beginnings whose rate differs between toxic and other labelled texts.

Labels say only whether a text is toxic.  Grades of the toxic ones are made here, from how many marking words they
hold (GRADE_EDGES), so the grades above 0 rank texts by what the model sees and are no judgement of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import discard, materialize, only, scan, texts
from tagloom.llm.licenses import normal_words

#: Most labelled rows of each label that a model is fitted on: those with the smallest hash of their id.
MAX_LABELLED = 4000
#: Least z-score of the difference between the two document rates of a word; all that reach it become features.
MIN_Z = 5.0
#: Bytes of the word beginnings that are features beside whole words; they catch stems with unseen endings.
BEGINNINGS = (4, 5, 6)
#: Probability of any grade above 0 from which a text counts as toxic.
THRESHOLD = 0.2
#: Grades of toxic texts rise at these numbers of words that mark toxic texts.
GRADE_EDGES = (3, 6)


def features(text: str) -> Counter:
    """Counts of the words of a text, and of their beginnings, written with a star."""
    out: Counter = Counter()
    for w, n in Counter(normal_words(text)).items():
        out[w] += n
        for size in BEGINNINGS:
            if len(w) >= size:
                out[w[:size] + b"*"] += n
    return out


@dataclass
class OrdinalModel:
    """Weights of words, and the thresholds between grades, lowest first."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def __post_init__(self):
        self.whole = {k: v for k, v in self.weights.items() if not k.endswith(b"*")}
        self.begin = [(size, known) for size in BEGINNINGS if (known := {k[:-1]: v for k, v in self.weights.items() if len(k) == size + 1 and k.endswith(b"*")})]

    def score(self, text: str) -> float:
        found: Counter = Counter()
        counts = Counter(normal_words(text))
        score = sum(self.whole[w] * (1 + math.log(counts[w])) for w in counts.keys() & self.whole.keys())
        for size, known in self.begin:
            found.clear()
            for w, n in counts.items():
                if (b := w[:size]) in known:
                    found[b] += n
            score += sum(known[b] * (1 + math.log(n)) for b, n in found.items())
        return score

    def grades(self, score: float) -> list[float]:
        """Probability of each grade."""
        below = [0.0, *(_logistic(t - score) for t in self.thresholds), 1.0]
        return [b - a for a, b in zip(below, below[1:], strict=False)]


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def sample_labels(labels: DataFrame, limit: int = MAX_LABELLED, label: str = "toxic") -> DataFrame:
    """doc_id and label of at most ``limit`` ids of each label, chosen by hash; null ids or labels are left out.

    An id with several labels counts as toxic if any says so.
    """
    one = labels.select("doc_id", F.col(label).cast("int").alias(label)).dropna().groupBy("doc_id").agg(F.max(label).alias(label))
    parts = [one.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_features(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """toxic, features and counts of the sampled rows, kept in the shared folder; at most 2 * ``limit`` ids."""
    joined = only(docs, "doc_id", "text").join(F.broadcast(sample_labels(labels, limit)), "doc_id")
    joined = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("toxic", "text")  # repeated ids are one row

    def rows(batch: pa.RecordBatch) -> list:
        counts = [features(t) for t in texts(batch)]
        return [batch.column("toxic"), [list(c) for c in counts], [list(c.values()) for c in counts]]

    return materialize(scan(joined, rows, "toxic int, features array<binary>, counts array<int>", limit=1 << 20))


def marks(sample: DataFrame, min_z: float = MIN_Z) -> dict[bytes, float]:
    """z-scores of all features whose share of toxic and other texts differs clearly; the sample bounds their number."""
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    seen = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("a"))
    share = F.col("n") / (n[0] + n[1])
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n[1] + 1 / n[0]))
    z = (F.col("a") / n[1] - (F.col("n") - F.col("a")) / n[0]) / spread
    chosen = seen.where("n >= 5").select("f", z.alias("z")).where(F.abs("z") >= min_z)
    return dict(sorted((bytes(r[0]), r[1]) for r in chosen.collect()))


def marked_rows(sample: DataFrame, known: dict[bytes, float]) -> list[tuple[int, dict[bytes, int]]]:
    """(toxic, counts) of the sample, of known features only, in a fixed order."""

    def rows(batch: pa.RecordBatch) -> list:
        pairs = [[(f, n) for f, n in zip(fs, ns, strict=True) if f in known] for fs, ns in zip(batch.column("features").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        return [batch.column("toxic"), [[f for f, _ in p] for p in pairs], [[n for _, n in p] for p in pairs]]

    got = scan(sample, rows, sample.schema).collect()
    return sorted(((r[0], dict(sorted(zip(map(bytes, r[1]), r[2], strict=True)))) for r in got), key=lambda r: (r[0], tuple(r[1].items())))


def severity(toxic: int, counts: dict[bytes, int], known: dict[bytes, float], edges: tuple[int, ...] = GRADE_EDGES) -> int:
    """Grade of a labelled text: 0 if not toxic, else 1 and one more for each edge that its marking words reach."""
    hits = sum(n for w, n in counts.items() if known.get(w, 0) > 0 and len(w) == BEGINNINGS[0] + 1 and w.endswith(b"*"))  # each word once
    return 1 + sum(hits >= e for e in edges) if toxic else 0


def fit(rows: list[tuple[int, dict[bytes, int]]], known: dict[bytes, float], rounds: int = 400, rate: float = 0.1, l2: float = 1e-3) -> OrdinalModel:
    """Fit weights and thresholds to (toxic, counts of known features) by Adam on the mean negative log-likelihood.

    Without rows of both labels nothing can be learnt: the model then gives every text grade 0.
    """
    if len({y for y, _ in rows}) < 2:
        return OrdinalModel()
    index = {w: i for i, w in enumerate(known)}
    grade = np.array([severity(y, c, known) for y, c in rows])
    levels = int(grade.max())
    grade = np.minimum(grade, levels)
    entry = [(r, index[w], 1 + math.log(n)) for r, (_, c) in enumerate(rows) for w, n in c.items() if w in index]
    row, column, value = (np.array(x) for x in zip(*entry, strict=True)) if entry else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, base, gaps = np.zeros(len(index)), np.array([1.0]), np.zeros(levels - 1)  # thresholds: base, then + exp(gap)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, base, gaps)]
    for t in range(1, rounds + 1):
        x = np.bincount(row, value * w[column], len(rows)) if len(row) else np.zeros(len(rows))
        theta = base[0] + np.r_[0, np.cumsum(np.exp(gaps))]
        upper, lower = np.r_[theta, np.inf][grade] - x, np.r_[-np.inf, theta][grade] - x
        a, b = 1 / (1 + np.exp(-np.clip(upper, -500, 500))), 1 / (1 + np.exp(-np.clip(lower, -500, 500)))
        da, db = a * (1 - a), b * (1 - b)
        da[grade == levels], db[grade == 0] = 0, 0
        p = np.maximum(np.where(grade == levels, 1, a) - np.where(grade == 0, 0, b), 1e-12)
        up, down = da / p / len(rows), db / p / len(rows)
        slope = up - down  # of the log-likelihood in -x
        to_theta = np.bincount(grade, up, levels + 1)[:levels] - np.bincount(grade, down, levels + 1)[1:]
        grads = [np.bincount(column, slope[row] * value, len(index)) + l2 * w if len(row) else w * 0, -np.array([to_theta.sum()]), -np.cumsum(to_theta[::-1])[::-1][1:] * np.exp(gaps)]
        for param, g, m in zip((w, base, gaps), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            param -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-8)
    theta = base[0] + np.r_[0, np.cumsum(np.exp(gaps))]
    return OrdinalModel({k: float(v) for k, v in zip(index, w, strict=True)}, tuple(map(float, theta)))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> OrdinalModel:
    """Model fitted on at most ``limit`` labelled rows of each label."""
    sample = labelled_features(docs, labels, limit)
    known = marks(sample)
    model = fit(marked_rows(sample, known), known)
    discard(sample)
    return model


SCORE_DDL = "severity double, grade int, p_toxic double, toxic boolean"


def rate(model: OrdinalModel, text: str, threshold: float = THRESHOLD) -> tuple[float, int, float, bool]:
    """Expected severity, grade, probability of any grade above 0, and whether that reaches ``threshold``.

    The grade is the likeliest one above 0 where it does, else 0.
    """
    p = model.grades(model.score(text))
    toxic = 1 - p[0]
    return sum(g * x for g, x in enumerate(p)), max(range(1, len(p)), key=p.__getitem__) if toxic >= threshold and len(p) > 1 else 0, toxic, toxic >= threshold


def score_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, severity (expected grade), grade, p_toxic and toxic of every row.

    Null and empty texts score as texts without any feature; repeated rows stay repeated; other columns are left out.
    Columns to keep must not have the names of the new ones.
    """
    if clash := set(keep) & set(T.StructType.fromDDL(SCORE_DDL).names):
        raise ValueError(f"columns of the input have names of results: {sorted(clash)}")
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(SCORE_DDL).fields])

    def rows(batch: pa.RecordBatch) -> list:
        made = [rate(model, t, threshold) for t in texts(batch, text)]
        return [*(batch.column(c) for c in keep), *map(list, zip(*made, strict=True))]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; the others keep all columns.

    Null and empty texts stay unless the model calls every text toxic, repeated rows are judged alike, and an empty
    table stays empty.
    """
    names = docs.columns

    def rows(batch: pa.RecordBatch) -> list | None:
        kept = batch.filter(pa.array([not rate(model, t, threshold)[3] for t in texts(batch, text)], pa.bool_()))
        return [kept.column(c) for c in names] if kept.num_rows else None

    return scan(docs, rows, docs.schema)


