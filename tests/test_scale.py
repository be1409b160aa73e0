"""Pieces whose faults show only on larger tables or in another form of the plan, against plain versions."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagloom.operators import dictionary, tables

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions,coalesce", [(4, True), (50, False)])
def test_numbers_of_many_rows(spark, partitions, coalesce):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 400_000
        wide = spark.range(n, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"), "id", F.repeat(F.md5(F.col("id").cast("string")), 10).alias("body"))
        got = tables.numbered(wide, [F.col("k").desc()], "n")
        assert tuple(got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()) == (n, n, 1, n, n)
        # numbers follow the order
        low = got.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("z"), F.count("*").alias("c")).orderBy("a").collect()
        assert [r.k for r in low] == sorted((r.k for r in low), reverse=True) and all(r.z - r.a + 1 == r.c for r in low)
        assert tables.numbered(wide.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_both_ways_of_matching_agree(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "the und 12the the-und"), (7, None), (8, ""), (8, "thethe the")], "doc_id long, text string"))
    entries = spark.createDataFrame([("the", 1), ("und", 1), ("the-und", 1), ("con la", 1), (". ", 1), ("12the", 1), ("nowhere", 1), ("a,", 1)], "surface string, weight int")
    columns = ("doc", "i", "start", "n", "surface", "end")
    one, other = (sorted((tuple(r[c] for c in columns) for r in dictionary._spans(docs, entries, "doc_id", F.col("text"), limit).collect()), key=str) for limit in (1000, 0))
    assert one == other and len(one) > 500
    for form in (1000, 0):
        assert dictionary._spans(docs, entries.limit(0), "doc_id", F.col("text"), form).count() == 0


def test_rows_of_a_product_are_checked(spark):
    with pytest.raises(ValueError):
        tables.set_product(spark.range(2).select(F.col("id").cast("string").alias("a")), spark.range(tables.PRODUCT_ROWS + 1).select(F.col("id").cast("string").alias("b")), "a", "b")


def test_phrase_sql_ends():
    """The SQL of phrases is written so that DuckDB makes each step once."""
    from tagloom.plans.registry import ORACLES

    con = duckdb.connect()
    con.register("documents", pq.read_table(f"{DIR}/documents.parquet"))
    assert con.execute(f"SELECT count(*) FROM ({ORACLES['new_words']})").fetchone()[0] > 0


def test_an_index_survives_broken_runs(spark, tmp_path):
    """Repeated batches and compactions that broke off leave what one clean run leaves."""
    from tagloom.operators import index

    path = f"file://{tmp_path}/index"
    rows = [(d, f"t{(d * k) % 17}", 1 + k % 3) for d in range(60) for k in range(1, 6)]
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long").groupBy("doc_id", "term").agg(F.max("tf").alias("tf"))
    index.append(spark, path, tf.where("doc_id < 30"), "1")
    index.append(spark, path, tf.where("doc_id >= 30"), "2")
    index.append(spark, path, tf.where("doc_id >= 30"), "2")  # run again
    plain = index.build(tf)

    def same():
        got = index.open_index(spark, path)
        assert (got.n_docs, got.avgdl) == (plain.n_docs, plain.avgdl)
        for a, b in ((got.postings, plain.postings), (got.docs, plain.docs), (got.terms, plain.terms)):
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))

    same()
    shard = spark.read.parquet(f"{path}/postings").first()["shard"]
    joined = spark.read.parquet(f"{path}/postings").where(F.col("shard") == shard).groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    joined.write.parquet(f"{path}/joined/shard={shard}")  # broke off before the parts went
    same()
    index.compact(spark, path, shard)
    same()
    index.save(plain, path)
    same()
    index.drop_index(spark, path)
    assert not (tmp_path / "index").exists()


def test_accuracy_in_the_order_of_the_model(spark):
    """The registered query against a plain count."""
    from tagloom.operators import ranking
    from tagloom.plans import retrieval

    rows = ranking.ranknet_score(retrieval.inputs(retrieval.labelled(spark, DIR)), ranking.RankNet(13)).select("imp", "rank", "hit", "uid", "query", F.round("ranknet", 6).alias("score")).collect()
    clicks = {(r.uid, r["query"]): r.n for r in retrieval.clicks(retrieval.results(spark, DIR)).groupBy("uid", "query").agg(F.count("*").alias("n")).collect()}
    by_imp: dict = {}
    for r in rows:
        by_imp.setdefault((r.imp, r.uid, r["query"]), []).append((-r.score, r["rank"], r.hit))
    for got in retrieval.acc_at_k_model(spark, DIR).collect():
        found = total = 0
        for (_, u, q), shown in by_imp.items():
            if n := clicks.get((u, q)):
                found, total = found + min(n, sum(h for *_, h in sorted(shown)[: got.k])), total + n
        assert abs(got.ranknet - found / total) < 1e-5


def shuffled(spark, run):
    """Megabytes that ``run`` sends through exchanges."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    return (total() - before) / 1e6


def test_packed_counts_of_chunks(spark):
    """Chunks, information and entropy of packed places against the plain tables, with ends, copies and a common pair."""
    import random

    from tagloom.operators import phrases

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["EOS", "a b"]
    rows = [[rng.choice(vocab[: rng.choice((3, 42))]) for _ in range(rng.randint(0, 9))] for _ in range(3000)] + [["x", "y", "z", "x", "y"]] * 500 + [None, ["solo"]]
    lines = spark.createDataFrame([(r,) for r in rows], "tokens array<string>").repartition(5)
    words, counted = phrases.unigrams(lines), phrases.follow(phrases.chunks(lines))
    grams = phrases.ngrams(counted)
    table = lambda df: {tuple(r[0]): tuple(round(x, 9) for x in r[1:]) for r in df.collect()}
    assert table(phrases.rated(lines)) == table(grams)
    assert table(phrases.rated(lines, pmi=True)) == table(phrases.chunk_pmi(grams, words))
    got = phrases.rated(lines, entropy=True)
    assert table(got.select("chunk", "entropy")) == table(phrases.right_entropy(counted)) and len(got.take(1))
    assert table(phrases.rated(lines, pmi=True, entropy=True, min_freq=3, min_pmi=0.2, min_entropy=0.4)) == table(phrases.chunk_pmi(grams, words).where("n >= 3 and pmi >= 0.2").join(phrases.right_entropy(counted).where("entropy >= 0.4"), "chunk"))
    assert phrases.rated(lines.limit(0), pmi=True, entropy=True).count() == 0


def test_buckets_are_joined_on_the_way(spark, monkeypatch):
    """A bucket with more places than are held at a time."""
    import numpy as np
    import pyarrow as pa

    from tagloom.operators import ngrams

    def body(k):
        rng = np.random.default_rng(k)
        token = pa.array([f"t{x}" for x in rng.permutation(9)])
        return ngrams._packed(pa.record_batch([token, pa.array(np.ones(9, np.int64))], ["token", "n"]), pa.record_batch([*(pa.array(rng.integers(int(j < 2), 10, 400)) for j in range(5)), pa.array(np.full(400, k + 1))], ["0", "1", "2", "3", "4", "n"]))

    def tree(limit):
        monkeypatch.setattr(ngrams, "BUCKET", limit)
        token, _, levels = ngrams._gathered(pa.py_buffer(body(k)) for k in range(8))
        return token.to_pylist(), [[x.tolist() for x in level] for level in levels]

    assert tree(1 << 20) == tree(100)


@pytest.mark.parametrize("name,most", [("chunk_pmi", 3.0), ("new_words", 3.0), ("right_entropy", 2.0), ("ngram_counts", 2.0)])
def test_places_are_exchanged_once(spark, name, most):
    from tagloom.plans import mining  # noqa: F401
    from tagloom.plans.registry import QUERIES

    sent = shuffled(spark, lambda: QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save())
    assert sent < most, sent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_rows(spark):
    """No exchange where ids differ; rows of one id are one document."""
    from tagloom.functions import text as fn
    from tagloom.operators.corpus import token_counts

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c " * 5000 + "a")], "doc_id long, text string")
    counted = token_counts(docs, tokenize=fn.words)
    assert "Exchange" not in plan(counted)
    assert sorted(map(tuple, counted.collect())) == [(1, "a", 2), (1, "b", 1), (4, "a", 1), (4, "c", 5000)]
    more = docs.union(spark.createDataFrame([(1, "b d"), (None, "x"), (None, "x y")], "doc_id long, text string"))
    assert sorted(map(tuple, token_counts(more, tokenize=fn.words).collect()), key=str) == sorted([(1, "a", 2), (1, "b", 2), (1, "d", 1), (4, "a", 1), (4, "c", 5000), (None, "x", 2), (None, "y", 1)], key=str)


def test_scores_meet_by_document_once(spark):
    """Few asked terms are broadcast: postings are exchanged by document only."""
    from tagloom.operators import index

    tf = spark.range(20_000).select(F.pmod("id", F.lit(500)).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") / 500).cast("int")).alias("term"), F.lit(1).cast("long").alias("tf"))
    asked = spark.createDataFrame([(1, "t1", 1.0), (2, "t1", 2.0), (2, "t3", 1.0)], "qid int, term string, weight double")
    got = index.score(index.build(tf), asked, cap=None)
    assert "hashpartitioning(term" not in plan(got) and "hashpartitioning(qid" not in plan(got) and got.count() == 1000


@pytest.mark.parametrize("name", ["doc_lengths", "tag_documents", "highlight", "dict_match", "doc_tag_counts"])
def test_tokens_are_not_spread_again(spark, name):
    """What a query derives from all tokens is written once, and lengths need no rows of tokens."""
    from tagloom.plans import mining, retrieval  # noqa: F401
    from tagloom.plans.registry import QUERIES

    df = QUERIES[name](spark, DIR)
    assert "Generate" not in plan(df) and "regexp_extract_all(lower(text" not in plan(df)


def test_painting_of_many_spans(spark):
    from tagloom.operators import search

    docs = spark.createDataFrame([(1, "the é the-x "), (2, None), (3, "the " * 20_000), (4, "")], "doc_id long, text string")
    marks = spark.createDataFrame([("the", 7), ("the-x", 9)], "surface string, level int")
    got = {r.doc_id: (r.html, r.used) for r in search.highlight(docs, marks).collect()}
    span = lambda t, w: f'<span style="color:rgb({w},0,0)">{t}</span>'
    assert got == {1: (span("the", 7) + " é " + span("the-x", 9) + " ", ["the", "the-x"]), 2: (None, []), 3: ((span("the", 7) + " ") * 20_000, ["the"]), 4: ("", [])}


def test_scores_by_document_agree_with_joined_ones(spark, monkeypatch):
    """Both ways of scoring give the same; a task gives no more than the best of its documents, ties and null ids included."""
    from tagloom.operators import index

    monkeypatch.setattr(index, "PAIRS", 64)
    tf = spark.range(4000).select((F.col("id") / 8).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(23))).alias("term"), (F.pmod("id", F.lit(3)) + 1).alias("tf"))
    idx = index.build(tf.groupBy("doc_id", "term").agg(F.max("tf").alias("tf")))
    asked = spark.createDataFrame([(1, "t1", 1.0), (2, "t1", 2.0), (2, "t3", 1.0), (None, "t5", 0.0), (None, "t6", -1.0), (3, "no", 1.0)], "qid int, term string, weight double")
    table = lambda df: {(r.qid, r.doc_id): round(r.score, 9) for r in df.collect()}
    for cap in (None, 7):
        assert table(index.score(idx, asked, cap=cap)) == table(index.score(idx, asked, cap=cap, held=0))
    some = index.score(idx, asked, cap=None, best=3)
    ranked = lambda df: sorted(((r.qid, r["rank"], r.doc_id) for r in index.top(df, 3).collect()), key=str)
    assert ranked(some) == ranked(index.score(idx, asked, cap=None, held=0)) and some.count() <= 9 * some.rdd.getNumPartitions()
    assert index.score(idx, asked.where("qid = 3"), cap=None, best=3).count() == 0
    assert index._rounded(np.array([1.0000005, -0.0000005, 2.0000015])).tolist() == [1.000001, -0.000001, 2.000002]


@pytest.mark.parametrize("name", ["best_paths", "render_results"])
def test_few_hits_go_to_the_index(spark, name):
    """Answers are written, so neither the index nor the documents are exchanged to meet them."""
    from tagloom.plans import retrieval  # noqa: F401
    from tagloom.plans.registry import QUERIES

    assert "hashpartitioning(doc_id" not in plan(QUERIES[name](spark, DIR))


def test_neighbours_are_counted_in_batches(spark):
    from tagloom.operators.corpus import neighbours

    rows = spark.createDataFrame([(["a", "b", "x", "a", "b"],), (None,), ([],), (["b"],), (["a", "a", None, "b", "a"],)], "w array<string>").coalesce(1)
    assert sorted(map(tuple, neighbours(rows, ["b", "a"]).collect())) == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1)]
    assert neighbours(rows, []).count() == 0


def test_phrases_are_rated_where_pairs_meet(spark):
    """Places are exchanged packed, and sums over overlapping pairs agree with a plain count."""
    import math
    import random
    from collections import Counter, defaultdict

    from tagloom.operators import phrases
    from tagloom.plans import mining  # noqa: F401
    from tagloom.plans.registry import QUERIES

    sent = shuffled(spark, lambda: QUERIES["phrase_topk"](spark, DIR).write.format("noop").mode("overwrite").save())
    assert sent < 6, sent
    rng = random.Random(7)
    rows = [[rng.choice("abcdefghijklmnopq"[: rng.choice((4, 17))]) for _ in range(rng.randint(0, 6))] for _ in range(400)] + [["x", "y"]] * 5 + [["b", "x", "y"]] * 2 + [["x", "y", "c"], ["x", "y", "c"], ["x", "d"]] + [["b", "x", "e"]]
    one, two, three = Counter(), Counter(), Counter()
    for t in (["^", *r, "$"] for r in rows):
        one.update(t), two.update(zip(t, t[1:])), three.update(zip(t, t[1:], t[2:]))
    h, sums = lambda p: -p * math.log(p), defaultdict(lambda: [0.0] * 4)
    for (x, y, z), n in three.items():
        sums[y, z][0] += h(n / two[y, z])
        sums[y, z][1] += h(n / two[x, y])
        sums[x, y][2] += h(n / two[x, y])
        sums[x, y][3] += h(n / two[y, z])
    wanted = {}
    for (a, b), n in two.items():
        pmi = math.log(n) - math.log(sum(two.values())) - math.log(one[a]) - math.log(one[b]) + 2 * math.log(sum(one.values()))
        if max(one[a], one[b]) > 3 and pmi >= 2:
            hl, hlr, hr, hrl = sums[a, b]
            wanted[a + b] = (pmi - min(hlr, hrl) + min(hl, hr)) * n
    got = {r.phrase: r.score for r in phrases.top_phrases(spark.createDataFrame([(r,) for r in rows] + [(None,)], "tokens array<string>").repartition(3)).collect()}
    assert len(wanted) > 1 and got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert phrases.top_phrases(spark.createDataFrame([], "tokens array<string>")).count() == 0


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    """Rows of results and postings are dealt to as many tasks as hold them, whatever the number of shuffle partitions."""
    from tagloom.operators import index
    from tagloom.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    tasks = fixtures.row_tasks(spark, DIR)
    assert tasks > 10 and f", {tasks}), REPARTITION_BY_NUM" in plan(fixtures.results(spark, DIR))
    monkeypatch.setattr(index, "TASK_ROWS", 500)
    tf = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("term"), F.lit(1).cast("long").alias("tf"))  # one term, one shard
    index.append(spark, f"file://{tmp_path}/index", tf, written=True)
    assert len(list((tmp_path / "index/postings").rglob("part-*.parquet"))) > 10 and index.open_index(spark, f"file://{tmp_path}/index").postings.count() == 10_000


def test_clicks_of_a_user_meet_results_at_once(spark):
    """Both ways of labelling agree, blanks, nulls and doubled clicks included, and impressions of two users count as before."""
    import random

    from tagloom.operators import ranking
    from tagloom.plans import retrieval  # noqa: F401
    from tagloom.plans.registry import QUERIES

    rng = random.Random(3)
    some = lambda *xs: rng.choice(xs)
    row = lambda: (some("a", "b", None), some("q", "r", None), some("T", " t", "u\u2003", "v", " ", "", None), some("x", "X ", "y", "\u00a0", None))
    shown = spark.createDataFrame([(*row(), some(1, 2, 3, 4, None), i, rng.random()) for i in range(400)], "uid string, query string, title string, url string, imp long, rank long, s double")
    clicked = spark.createDataFrame([row() for _ in range(9)] * 2, "uid string, query string, title string, url string")
    table = lambda df: sorted(map(str, df.collect()))
    one = ranking.label(shown, clicked, 3)
    assert table(one) == table(ranking.label(shown, clicked, 3, most=0)) == table(ranking.label(shown, clicked)) and 0 < one.where("hit").count() < 400
    n = ranking.join_clicks(shown.select("uid", "query", "imp").distinct(), clicked.groupBy("uid", "query").agg(F.count("*").alias("n"))).select("imp", "n")
    orders = {"origin": -F.col("rank"), "s": F.col("s")}
    got = ranking.share_found(ranking.placed(one, orders), tuple(orders), clicked, (1, 3, 200), 3)
    assert table(got) == table(ranking.accuracy_at(one, orders, n, (1, 3, 200))) and got.count() == 3
    assert ranking.share_found(ranking.placed(one, orders).limit(0), tuple(orders), clicked, (1,), 3).count() == 0
    x = np.random.default_rng(0).random((700, 13)) * 50
    assert np.allclose(ranking.RankNet(13).score(x), ranking.RankNet(13).forward(x)[0], rtol=0, atol=1e-12)
    sent = shuffled(spark, lambda: QUERIES["acc_at_k_model"](spark, DIR).write.format("noop").mode("overwrite").save())
    assert sent < 0.8, sent


def test_known_queries_need_no_exchange_of_postings(spark, monkeypatch):
    """An index for asked terms gives what that of all terms gives, with shared ids, nulls and empty documents."""
    from tagloom.functions import text as fn
    from tagloom.operators import corpus, index
    from tagloom.plans import retrieval  # noqa: F401
    from tagloom.plans.registry import QUERIES

    monkeypatch.setattr(corpus, "BLOCK_TOKENS", 8)
    rows = [(i, f"t{i % 7} t{i % 3} x t{i % 7}" + " y" * (i % 5)) for i in range(90)] + [(3, "t1 t2"), (3, "z"), (5, None), (200, None), (201, ""), (202, "z z"), (None, "t1 t2"), (None, "t1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "t", 1.0), (2, "x", 2.0), (2, "z", 1.0), (3, "nowhere", 1.0), (3, "y", 0.5)], "qid int, term string, weight double")
    table = lambda df: sorted(((r.qid, r.doc_id, round(r.score, 9)) for r in df.collect()), key=str)
    for some in (docs, docs.where("doc_id > 5")):
        whole = index.build(corpus.token_counts(some, tokenize=fn.words))
        few = index.build_asked(corpus.asked_counts(some, ["z", "x", "nowhere", "t", "y"], tokenize=fn.words))
        assert (few.n_docs, few.avgdl) == (whole.n_docs, whole.avgdl) and few.terms.count() == 4
        wanted = table(index.score(whole, asked, cap=None))
        assert len(wanted) > 80 and wanted == table(index.score(few, asked, cap=None)) == table(index.score(few, asked, cap=None, held=0)) == table(index.score(few, asked, cap=1000))
    none = index.build_asked(corpus.asked_counts(docs, [], tokenize=fn.words))
    assert none.n_docs == whole_count(docs) and none.postings.count() == 0
    q = asked.where("qid < 3")
    assert table(index.score(retrieval.asked_index(spark, DIR, q), q, cap=None)) == table(index.score(retrieval.asked_index(spark, DIR, q, held=1), q, cap=None))
    for name in ("bm25_weighted_topk", "bm25_topk"):
        assert "hashpartitioning(doc_id" not in plan(QUERIES[name](spark, DIR))


def whole_count(docs):
    from tagloom.functions import text as fn

    return docs.where(F.size(fn.words("text")) > 0).select("doc_id").distinct().count()
