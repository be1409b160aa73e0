"""Search end to end: recall over expanded terms, explanation, highlighting and rendering."""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import escape_html, normal_query
from tagloom.operators import dictionary, graph, index
from tagloom.operators.corpus import token_counts
from tagloom.sources.workspace import settle, settled

#: BM25's b in search, documents shown, paths shown for each.
B = 0.3
SHOWN = 10
PATHS = 3


class Found:
    """terms (qid, term, weight), paths (qid, path, end, w) and hits (qid, doc_id, score, rank).

    Each is written when it is first asked for, since all are small beside the index: the planner then knows their size.
    """

    def __init__(self, terms: DataFrame, reached: DataFrame, idx: index.Index, limit: int, b: float):
        self.terms, self._reached, self._idx, self._limit, self._b = settle(terms), reached, idx, limit, b

    @cached_property
    def paths(self) -> DataFrame:
        return settle(graph.explain(self.terms, self._reached))

    @cached_property
    def hits(self) -> DataFrame:
        return settle(index.top(index.score(self._idx, self.terms, b=self._b, cap=None, best=self._limit), self._limit))

    def shown(self, shown: int) -> DataFrame:
        """The first hits of each query as a table of their own."""
        return settle(self.hits.where(F.col("rank") <= shown))


def query_terms(queries: DataFrame, entries: DataFrame, tokenize) -> DataFrame:
    """qid and term of queries (qid, text): every token but a space, and each dictionary hit once more."""
    clean = queries.select("qid", normal_query("text").alias("text"))
    tokens = clean.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).where("term <> ' '")
    hits = dictionary.match(clean, entries, "qid", "text").select("qid", F.col("surface").alias("term")).distinct()
    return tokens.unionByName(hits)


def document_terms(docs: DataFrame, entries: DataFrame, tokenize, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term and tf: tokens count once each, dictionary hits once for each span on top."""
    lower = docs.select(F.col(doc).alias("doc_id"), F.lower(F.regexp_replace(text, " +", " ")).alias("text"))
    entries = settled(entries)
    tokens = settle(token_counts(lower, tokenize=tokenize))
    hits = dictionary.match(lower, entries).select("doc_id", F.col("surface").alias("term"), F.lit(1).cast("long").alias("tf"))
    # only terms that are entries can have hits as well
    marked = entries.select(F.col("surface").alias("term")).distinct()
    both = tokens.join(marked, "term", "left_semi").select("doc_id", "term", "tf").unionByName(hits).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    return tokens.join(marked, "term", "left_anti").select("doc_id", "term", "tf").unionByName(both)


def search(queries: DataFrame, entries: DataFrame, nodes: DataFrame, edges: DataFrame, idx: index.Index, tokenize, limit: int = 100, b: float = B) -> Found:
    """Answers to all queries (qid, text); all postings of a term count."""
    terms = settle(query_terms(queries, entries, tokenize))
    seeds = graph.known_nodes(terms, nodes).select("qid", F.col("term").alias("seed")).distinct()
    reached = graph.expand(seeds, edges)
    return Found(graph.query_weights(terms, nodes, reached), reached, idx, limit, b)


def levels(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, term, level (55 to 255) of the colour and pw, the term's weight for paths; unknown terms are left out."""
    mult = F.col("idf") * 0.25
    rated = weights.join(terms.select("term", "idf"), "term")
    return rated.select("qid", "term", F.floor(F.least(F.greatest(F.col("weight") * mult, F.lit(0.0)), F.lit(1.0)) * 200 + 55 + F.lit(1e-9)).cast("int").alias("level"), (mult * 0.25).alias("pw"))


def highlight(docs: DataFrame, marks: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, html and used: texts with the marks (surface, level) in colour, and the texts of those spans.

    Marks are looked up in the lower-cased text; of overlapping ones the leftmost and then longest counts.
    """
    lower = docs.select(F.col(doc).alias("doc_id"), F.lower(text).alias("text"))
    entries = marks.groupBy("surface").agg(F.max("level").cast("long").alias("weight"))
    spans = dictionary.match(lower, entries).join(entries, "surface")
    ordered = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "weight"))).alias("spans"))
    joined = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(ordered, "doc_id", "left")
    return joined.select("doc_id", *painted(F.col("text"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,e:bigint,weight:bigint>>"))))


def painted(text: Column, spans: Column) -> tuple[Column, Column]:
    """html and used from spans (start, -end, weight) in order; what begins inside the last one is passed over."""

    @F.pandas_udf("html string, used array<string>")
    def paint(text: pd.Series, start: pd.Series, end: pd.Series, weight: pd.Series) -> pd.DataFrame:
        html, used = [], []
        for t, *places in zip(text, start, end, weight, strict=True):
            if t is None:
                html.append(None)
                used.append([])
                continue
            at, out, found = 0, [], set()
            for a, e, w in zip(*places, strict=True):
                if a >= at:
                    out += (t[at:a], f'<span style="color:rgb({w},0,0)">', t[a:e], "</span>")
                    found.add(t[a:e])
                    at = e
            html.append("".join(out) + t[at:])
            used.append(sorted(found))
        return pd.DataFrame({"html": html, "used": used})

    drawn = paint(text, F.transform(spans, lambda x: x["start"]), F.transform(spans, lambda x: -x["e"]), F.transform(spans, lambda x: x["weight"]))
    return drawn["html"].alias("html"), drawn["used"].alias("used")


def best_paths(paths: DataFrame, used: DataFrame, limit: int = PATHS) -> DataFrame:
    """qid, doc_id, path and rank of the best ways that end in a term used in the document (qid, doc_id, term, pw)."""
    rated = paths.withColumnRenamed("end", "term").join(used, ["qid", "term"]).withColumn("s", F.col("w") * F.col("pw"))
    line = F.array_join(F.transform("path", lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("-"), x, F.lit("->"))).otherwise(x)), " ")
    rank = F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.round("s", 9).desc(), "path"))
    return rated.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "doc_id", line.alias("path"), "rank")


def render(found: Found, docs: DataFrame, idx: index.Index, shown: int = SHOWN) -> DataFrame:
    """qid, doc_id, rank and html of the best documents of each query: id, score, coloured text and its best ways."""
    top = found.shown(shown)
    marks = settle(levels(found.terms, idx.terms))
    key = F.concat_ws("\u0001", F.col("qid").cast("string"), F.col("doc_id").cast("string"))
    # texts are taken out of the documents once, and only they are escaped
    pages = settle(docs.select("doc_id", "text").join(top, "doc_id").select("qid", "doc_id", "rank", "score", escape_html("text").alias("text"), key.alias("k")))
    # marks differ by query, so texts are matched with all marks and spans of other queries drop out
    entries = marks.groupBy(F.col("term").alias("surface")).agg(F.lit(1).cast("long").alias("weight"))
    spans = dictionary.match(pages.select("k", F.lower("text").alias("text")), entries, "k").withColumn("qid", F.split("k", "\u0001")[0])
    spans = spans.join(marks.select(F.col("qid").cast("string").alias("qid"), F.col("term").alias("surface"), F.col("level").cast("long").alias("weight")), ["qid", "surface"])
    ordered = spans.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "weight"))).alias("spans"))
    drawn = pages.join(ordered, "k", "left").select("qid", "doc_id", "rank", "score", *painted(F.col("text"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,e:bigint,weight:bigint>>"))))
    drawn = settle(drawn)  # read twice
    used = drawn.select("qid", "doc_id", F.explode("used").alias("term")).join(marks.select("qid", "term", "pw"), ["qid", "term"])
    ways = best_paths(found.paths, used).groupBy("qid", "doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), "<br/>").alias("ways"))
    html = F.concat(F.lit("<a>"), F.col("doc_id").cast("string"), F.format_string("</a> %.2f<br/>", "score"), "html", F.lit("<br/><br/>"), F.coalesce("ways", F.lit("")))
    return drawn.join(ways, ["qid", "doc_id"], "left").select("qid", "doc_id", "rank", html.alias("html"))


def response(rendered: DataFrame) -> DataFrame:
    """qid and the JSON answer with its pages in order of rank."""
    pages = F.transform(F.sort_array(F.collect_list(F.struct("rank", "html"))), lambda x: x["html"])
    return rendered.groupBy("qid").agg(F.to_json(F.struct(pages.alias("ret"))).alias("json"))
