"""Worked examples whose results are known, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.operators import dictionary, graph, index, phrases, ranking, relations, search, tables
from tagloom.operators.corpus import segment


def entries(spark, *surfaces):
    return spark.createDataFrame([(s, 1) for s in surfaces], "surface string, weight long")


def test_spans(spark):
    docs = spark.createDataFrame([(1, "you are我们de飞机"), (2, "iots iot"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end, r.surface) for r in dictionary.match(docs, entries(spark, "you are", "are", "我们", "我们de飞", "iot")).collect()}
    assert got == {(1, 0, 7, "you are"), (1, 4, 7, "are"), (1, 7, 9, "我们"), (1, 7, 12, "我们de飞"), (2, 5, 8, "iot")}


def test_spans_cut_to_their_surface(spark):
    text = "a b-c a b. a"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = dictionary.match(docs, entries(spark, "a", "a b", "b-c")).collect()
    assert len(got) == 6 and all(text[r.start : r.end] == r.surface for r in got)


def test_document_tags(spark):
    docs = spark.createDataFrame([("d", "项目项目软件")], "doc_id string, text string")
    got = dictionary.tag(docs, entries(spark, "项目", "软件", "项目计划")).first().tags
    assert [(t.end_index, t.tag) for t in got] == [(4, "项目"), (8, "项目"), (12, "软件")]


def test_cooccurrence(spark):
    docs = spark.createDataFrame([(["项目", "项目", "软件", "PPT"],)], "tags array<string>")
    got = {(r.u, r.v): round(r.w, 6) for r in relations.cooccurrence(docs).collect()}
    assert got == {("软件", "项目"): 0.4, ("项目", "软件"): 1.0, ("PPT", "软件"): 1.0, ("软件", "PPT"): 0.6}


def test_symmetric_cooccurrence_knows_no_order(spark):
    a = spark.createDataFrame([(["x", "yy", "z"],)], "tags array<string>")
    b = spark.createDataFrame([(["z", "yy", "x"],)], "tags array<string>")
    one, two = ({(r.u, r.v, r.w) for r in relations.cooccurrence(d, mode="symmetric").collect()} for d in (a, b))
    assert one == two


def test_new_words(spark):
    lines = spark.createDataFrame([(["全部", "分类"],), (["分类"],), (["基站", "平台", "软件"],), (["基站", "北", "研", "组"],)], "tokens array<string>")
    places = phrases.chunks(lines)
    pmi = {"".join(r.chunk): r.pmi for r in phrases.chunk_pmi(phrases.ngrams(places), phrases.unigrams(lines), 10).collect()}
    for s in ("全部分类", "基站平台", "基站北"):
        assert math.isclose(pmi[s], math.log(5))
    for s in ("基站平台软件", "基站北研", "基站北研组", "平台软件", "北研", "北研组", "研组"):
        assert math.isclose(pmi[s], math.log(10))
    # only the longest chunk has an artificial end beside the real one, which is the same token
    assert phrases.right_entropy(places).count() == 0


def test_ages_of_results(spark):
    rows = spark.createDataFrame([("1535557620", None), (None, None)], "a string, b string")
    got = [r[0] for r in rows.select(ranking.age_days(F.lit(1e9 + 86400 * 3), "a", "b")).collect()]
    assert got == [0.0, 3.0]


def test_pairs_and_accuracy(spark):
    shown = spark.createDataFrame([(1, "u", "q", 0, "A ", "x"), (1, "u", "q", 1, "b", "y"), (1, "u", "q", 2, "c", "z"), (2, "u", "p", 0, "d", "w")], "imp int, uid string, query string, rank int, title string, url string")
    clicked = spark.createDataFrame([("u", "q", "a", " "), ("u", "p", "none", "")], "uid string, query string, title string, url string")
    lab = ranking.label(shown, clicked)
    assert {(r.imp, r.positive, r.negative) for r in ranking.pairs(lab).collect()} == {(1, 0, 1), (1, 0, 2)}
    n = spark.createDataFrame([(1, 1), (2, 1)], "imp int, n int")
    acc = {r.k: r.origin for r in ranking.accuracy_at(lab, {"origin": -F.col("rank")}, n).collect()}
    assert set(acc.values()) == {0.5} and set(acc) == set(ranking.DEPTHS)


def test_ranknet_learns_and_its_gradient_is_right():
    import numpy as np

    rng = np.random.default_rng(0)
    m = ranking.RankNet(5, hidden=6, layers=2)
    x = rng.normal(size=(3, 5))
    up = rng.normal(size=3)
    g = m.gradient(x, up)
    for k, w in m.weights.items():
        i = tuple(rng.integers(0, s) for s in w.shape)
        old = w[i]
        w[i] = old + 1e-6
        a = (m.forward(x)[0] * up).sum()
        w[i] = old - 1e-6
        b = (m.forward(x)[0] * up).sum()
        w[i] = old
        assert math.isclose((a - b) / 2e-6, g[k][i], rel_tol=1e-4, abs_tol=1e-6), k
    better, worse = rng.normal(size=(400, 5)) + np.array([1, 0, 0, 0, 0]), rng.normal(size=(400, 5))
    losses = ranking.RankNet(5).fit(better, worse, epochs=5)
    assert losses[-1] < math.log(2)
    with pytest.raises(ValueError):
        m.fit(better[:0], worse[:0])


def test_idf_and_bm25(spark):
    tf = spark.createDataFrame([("a", "x", 2), ("a", " ", 3), ("b", "x", 1), ("c", "y", 70000)], "doc_id string, term string, tf long")
    idx = index.build(tf)
    assert {(r.term, r.doc_id, r.tf) for r in idx.postings.collect()} == {("x", "a", 2), ("x", "b", 1), ("y", "c", 65535)}
    assert {r.doc_id: r.dl for r in idx.docs.collect()} == {"a": 5.0, "b": 1.0, "c": 70000.0}
    assert all(r.idf >= math.log(1.0001) - 1e-12 for r in idx.terms.collect())
    q = spark.createDataFrame([(1, "x", 2.0), (1, "unknown", 1.0)], "qid int, term string, weight double")
    assert [r.doc_id for r in index.top(index.score(idx, q)).orderBy("rank").collect()] == ["a", "b"]


def test_expansion(spark):
    edges = spark.createDataFrame([("KGm", "a", "b", 0.9), ("KGm", "b", "c", 0.9), ("coocc", "a", "c", 0.9), ("KGm", "b", "a", 1.0), ("zzz", "a", "d", 1.0)], "tp string, u string, v string, w double")
    seeds = spark.createDataFrame([(1, "a"), (1, "lone")], "qid int, seed string")
    got = {(r.seed, r.node): (round(r.w, 6), r.path) for r in graph.expand(seeds, edges).collect()}
    assert got[("a", "c")] == (round(0.63 * 0.63, 6), ["a", "KGm", "b", "KGm", "c"])
    assert ("a", "d") not in got and got[("lone", "lone")] == (1.0, ["lone"])
    queue = {(r.seed, r.node): r.w for r in graph.expand(seeds, edges, mode="fifo").collect()}
    assert all(w <= got[k][0] + 1e-6 for k, w in queue.items())


def test_highlight(spark):
    docs = spark.createDataFrame([(1, "Big data, big"), (2, "none")], "doc_id long, text string")
    marks = spark.createDataFrame([("big data", 90), ("big", 60), ("data", 70)], "surface string, level int")
    got = {r.doc_id: (r.html, r.used) for r in search.highlight(docs, marks).collect()}
    assert got[1] == ('<span style="color:rgb(90,0,0)">Big data</span>, <span style="color:rgb(60,0,0)">big</span>', ["Big data", "big"])
    assert got[2] == ("none", [])


def test_segments(spark):
    docs = spark.createDataFrame([("f", " a \nb\n\n\n----------------x\nc  d   e ﬁ\n"), ("s.pptx", "a\n\nb"), ("e", "")], "name string, text string")
    got = {r.id: r.text for r in segment(docs, "name").collect()}
    assert got == {"f@0": "ab", "f@1": "c  d  e fi", "s.pptx@0": "ab"} or got == {"f@0": "ab", "f@1": "c  d  e fi", "s.pptx@0": "ab", "e@0": ""}


def test_commands(spark):
    assert tables.parse_command('SELECT x[0] FROM A WHERE x[1]=="B c"')["where"] == "x[1]=='b c'"
    rows = spark.createDataFrame([(["a", "1"],), (["b"],)], "cols array<string>")
    assert [tuple(r) for r in tables.run_command({"t": rows}, "select x[0], concat(x[0], ',', x[1]) from t where x[1] is not null").collect()] == [("a", "a,1")]
    with pytest.raises(ValueError):
        tables.split_by_arity(rows, 1)


def test_links(spark):
    rows = spark.createDataFrame([("http://h/a/b.html", h) for h in ("c", "/c", "//x/y", "https://z", "mailto:q")], "u string, h string")
    assert [r[0] for r in rows.select(fn.absolute("u", "h")).collect()] == ["http://h/a/c", "http://h/c", "http://x/y", "https://z", "mailto:q"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in relations.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
