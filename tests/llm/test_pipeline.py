"""The pipeline and the queries over the smallest tables."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
import tokenizers

from tagloom.llm import bpe, queries
from tagloom.llm.common import load, materialize

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert df.count() > 0 and "doc_id" in df.columns


def test_stages(spark):
    docs = start = load(spark, DIR, "documents")
    seen = {r.doc_id for r in start.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and len(ids) == len(set(ids)) and ids, name
        if name in ("secrets", "bpe"):
            assert set(ids) == seen
        if name == "secrets":
            texts = {r.doc_id: r.text for r in docs.collect()}
        seen = set(ids)
        if name != "bpe":
            assert docs.columns == start.columns
    plain = tokenizers.Tokenizer.from_file(bpe.default_path())
    for r in docs.collect():
        assert r.n_tokens == len(plain.encode(texts[r.doc_id], add_special_tokens=False).ids)


def plain_kept(rows, similarity=0.8):
    """Ids that stay: the smallest of each component of texts whose sets of five words are alike."""
    from test_texts import jaccard, roots

    def cut(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for _, t in rows]
    of = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= similarity])
    first: dict = {}
    for (d, _), g in zip(rows, of, strict=True):
        first[g] = min(first.get(g, d), d)
    return set(first.values())


def test_near_copies_go_and_others_stay(spark):
    """Copies with known similarities on both sides of 0.8, against all pairs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioukstr") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(60):
        w = [word() for _ in range(400)]
        rows.append((i, " ".join(w)))
        for k in range(3):  # as many words changed, far from each other, as give 5 n of 396 other shingles
            n = rng.choice([1, 3, 5, 7, 8, 9, 10, 12, 16])
            changed = {40 * p + 3 if n <= 10 else 24 * p + 3 for p in range(n)}
            rows.append((1000 + 10 * i + k, " ".join(word() + "x" if p in changed else x for p, x in enumerate(w))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, DIR).collect()}
    wanted = plain_kept(rows)
    assert wanted <= kept and len(kept - wanted) <= 0.03 * (len(rows) - len(wanted))


def test_pipeline_is_its_stages_in_plain_form(spark):
    """run() against plain versions of its stages, but for the model's verdicts, which are taken as they are."""
    from tagloom.llm import decontamination, secrets, toxicity

    docs, bench = load(spark, DIR, "documents"), load(spark, DIR, "benchmark").collect()
    model = toxicity.train(docs, load(spark, DIR, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if not toxicity.rate(model, r.text or "")[3]]
    stay = plain_kept(rows)
    index = decontamination.Index([(b.item_id, b.text) for b in bench], decontamination.Rule())
    rows = [(d, t) for d, t in rows if d in stay and not index.find(decontamination.normal(t or ""))]
    plain = tokenizers.Tokenizer.from_file(bpe.default_path())
    wanted = {}
    for d, t in rows:
        gone, masked = set(), ""
        for a, b, _ in secrets.spans(t or ""):
            gone |= set(range(a, b))
        for i, c in enumerate(t or ""):
            masked += c if i not in gone else "[secret]" if i - 1 not in gone or any(a == i for a, _, _ in secrets.spans(t)) and not any(a < i < b for a, b, _ in secrets.spans(t)) else ""
        wanted[d] = hashlib.sha256(np.array(plain.encode(masked, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == wanted and len(got) > 100


def test_sources_name_no_local_checkpoint():
    import pathlib

    for p in pathlib.Path(queries.__file__).parent.glob("*.py"):
        assert not re.search(r"localCheckpoint|\.rdd\b", p.read_text())
