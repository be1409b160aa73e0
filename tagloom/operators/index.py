"""Inverted index and BM25."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources.workspace import delete, discard, exists, fresh_path, rename, settle, settled

#: Shards of the index, the largest tf, postings read of a term, and parts of the idf formula.
SHARDS = 100
TF_CAP = 65_535
READ_CAP = 10_000
IDF_FLOOR = 1.0001
#: Tokens that are parts of this text aren't indexed, but count for a document's length.
BLANKS = "\r\t\n "
#: Most rows of asked terms that every task holds, pairs of a posting and a query that are summed at a time, and
#: postings that a task sorts and writes, as planned.
ASKED = 1 << 20
PAIRS = 1 << 22
TASK_ROWS = 1 << 20


@dataclass
class Index:
    """postings (term, doc_id, tf), docs (doc_id, dl), terms (term, df, idf), and the totals n_docs and avgdl.

    With ``whole``, a document's postings follow one another in one task and hold its dl.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    whole: bool = False


def postings(tf: DataFrame, *more: str) -> DataFrame:
    """term, doc_id and tf: tf capped and cut to an integer, tokens of blanks left out; and columns that are to stay."""
    kept = tf.where(~F.contains(F.lit(BLANKS), "term"))
    return kept.select("term", "doc_id", F.least(F.floor("tf"), F.lit(TF_CAP)).cast("long").alias("tf"), *more)


def doc_lengths(tf: DataFrame) -> DataFrame:
    """doc_id and dl, the sum of all tf, blanks included."""
    return tf.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("dl"))


def idf(n: Column, df: Column, floor: float = IDF_FLOOR) -> Column:
    """Logarithm of the odds against a term; odds are at least ``floor``."""
    return F.log(F.greatest((n - df + F.lit(0.5)) / (df + F.lit(0.5)), F.lit(floor)))


def term_stats(posts: DataFrame, n_docs: int, floor: float = IDF_FLOOR) -> DataFrame:
    """term, df and idf."""
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(float(n_docs)), F.col("df"), floor))


def external_idf(posts: DataFrame, given: DataFrame) -> DataFrame:
    """term, df and the idf of a table (term, idf), 0 for terms that it lacks."""
    own = posts.groupBy("term").agg(F.count("*").alias("df"))
    return own.join(given.select("term", "idf"), "term", "left").select("term", "df", F.coalesce("idf", F.lit(0.0)).alias("idf"))


def build(tf: DataFrame) -> Index:
    """Index of (doc_id, term, tf); the tables are written once, if they aren't yet, and read by every query."""
    tf = settled(tf)
    posts = postings(tf)
    docs = settle(doc_lengths(tf))
    n, mean = docs.agg(F.count("*"), F.avg("dl")).first()
    return Index(posts, docs, settle(term_stats(posts, n)), n, mean or 0.0)


def build_asked(counts: DataFrame) -> Index:
    """Index for known queries from (doc_id, dl, hits: term and tf of their terms), one row for each document.

    Lengths and totals are of all documents with a token; postings and terms are those of the hits.
    """
    rows = settle(counts.where("dl > 0"))
    n, mean = rows.agg(F.count("*"), F.avg("dl")).first()
    posts = postings(rows.select("doc_id", "dl", F.explode("hits").alias("h")).select("doc_id", "dl", "h.term", "h.tf"), "dl")
    return Index(posts, rows.select("doc_id", "dl"), settle(term_stats(posts, n)), n, mean or 0.0, True)


def capped(posts: DataFrame, cap: int = READ_CAP) -> DataFrame:
    """The first ``cap`` postings of each term in order of doc_id."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
    return posts.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def save(index: Index, path: str) -> None:
    """Write the index as the only batch of a new one: postings in ``SHARDS`` folders by term."""
    drop_index(index.postings.sparkSession, path)
    _write(index.postings, index.docs, index.terms.select("term", "df"), path, "0")
    index.terms.write.parquet(f"{path}/terms")


def _write(posts: DataFrame, docs: DataFrame, df: DataFrame, path: str, batch: str) -> None:
    sharded = posts.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(SHARDS)).cast("int"))
    # ranges of about equal size, whatever the number of shards and the commonest terms
    tasks = max(posts.sparkSession.sparkContext.defaultParallelism, -(-posts.count() // TASK_ROWS))
    sharded.repartitionByRange(tasks, "shard", "term", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings/batch={batch}")
    docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch}")
    df.write.mode("overwrite").parquet(f"{path}/df/batch={batch}")


def open_index(spark: SparkSession, path: str) -> Index:
    """What :func:`save` and :func:`append` have written; document frequencies of the batches are added up."""
    _finish(spark, path)
    posts, docs = spark.read.parquet(f"{path}/postings").drop("shard", "batch"), spark.read.parquet(f"{path}/docs").drop("batch")
    n, mean = docs.agg(F.count("*"), F.avg("dl")).first()
    if exists(spark, f"{path}/terms"):
        terms = spark.read.parquet(f"{path}/terms")
    else:
        terms = spark.read.parquet(f"{path}/df").groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", idf(F.lit(float(n)), F.col("df")))
    return Index(posts, docs, terms, n, mean or 0.0)


def append(spark: SparkSession, path: str, tf: DataFrame, batch: str | None = None, written: bool = False) -> None:
    """Add documents as a batch of their own; ``written`` says that ``tf`` is read from a table and costs no work.

    A batch that is written again under its name takes the place of what it left before, so a run that was broken off
    can be repeated; earlier batches aren't read.
    """
    tf = tf if written else settle(tf)
    posts = postings(tf)
    delete(spark, f"{path}/terms")
    _write(posts, doc_lengths(tf), posts.groupBy("term").agg(F.count("*").alias("df")), path, batch or uuid.uuid4().hex)
    if not written:
        discard(tf)


def compact(spark: SparkSession, path: str, shard: int) -> None:
    """Join one shard's postings of all batches, sorted by term and without repeated rows.

    The new folder is complete before the old ones go; a run that breaks off in between is finished by the next one,
    or when the index is opened.  Batches of a stream that may still be repeated must not be joined.
    """
    _finish(spark, path)
    rows = spark.read.parquet(f"{path}/postings").where(F.col("shard") == shard).groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/joined/shard={shard}")
    _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> None:
    """Put joined shards that are complete in place of their parts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/joined/shard=*/_SUCCESS")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for done in files.globStatus(at) or ():
        folder = done.getPath().getParent()
        for part in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/batch=*/{folder.getName()}")) or ():
            files.delete(part.getPath(), True)
        rename(spark, folder.toString(), f"{path}/postings/batch=joined/{folder.getName()}")


def drop_index(spark: SparkSession, path: str) -> None:
    """Delete an index."""
    delete(spark, path)


def scratch(spark: SparkSession) -> str:
    return fresh_path(spark)


def score(index: Index, query: DataFrame, k1: float = 1.5, b: float = 0.75, cap: int | None = READ_CAP, best: int | None = None, held: int = ASKED) -> DataFrame:
    """qid, doc_id and BM25 score for each query of ``query`` (qid, term, weight); unknown terms score nothing.

    Only postings of the queries' terms are read.  Weights multiply, so a repeated word is a weight of two.  With
    ``best``, a task gives only those of its documents that can be among so many of a query in the order of :func:`top`.
    Up to ``held`` asked terms go to every task, where a document's postings are summed at once; more are joined.
    """
    asked = settle(query.groupBy("qid", "term").agg(F.sum("weight").alias("weight")))
    terms = settle(index.terms.select("term", "idf").join(asked, "term"))
    if terms.count() <= held:
        return _score_by_document(index, terms, k1, b, cap, best)
    wanted = index.postings.select("term", "doc_id", "tf").join(terms.select("term"), "term", "left_semi")
    posts = (capped(wanted, cap) if cap else wanted).repartition("doc_id").join(index.docs, "doc_id")
    tf, norm = F.col("tf").cast("double"), F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl))
    each = posts.join(terms, "term").select("qid", "doc_id", (F.col("weight") * F.col("idf") * tf * F.lit(k1 + 1) / (tf + norm)).alias("s"))
    return each.groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))


def _score_by_document(index: Index, terms: DataFrame, k1: float, b: float, cap: int | None, best: int | None) -> DataFrame:
    """Scores from few terms (term, idf, qid, weight): postings come as numbers, in the order of their documents."""
    table = terms.select("term", "qid", (F.col("weight") * F.col("idf")).alias("w")).toArrow()
    words, asks = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "qid"))
    term, ask, weight = words.indices.to_numpy(), asks.indices.fill_null(len(asks.dictionary)).to_numpy(), table.column("w").to_numpy()
    qids = pa.concat_arrays([asks.dictionary, pa.nulls(1, asks.dictionary.type)])
    order = np.argsort(term, kind="stable")
    ask, weight, starts = ask[order].astype(np.int64), weight[order], np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))
    spark = terms.sparkSession
    numbers = spark.createDataFrame(pa.table({"term": words.dictionary, "t": pa.array(np.arange(len(words.dictionary)), pa.int32())}))
    wanted = index.postings.join(F.broadcast(numbers), "term")  # their number is checked
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl))
    if index.whole and not cap:  # nothing has to meet
        posts = wanted.where("doc_id is not null").select("doc_id", "t", F.col("tf").cast("double").alias("tf"), norm.alias("norm"))
    else:
        posts = (capped(wanted, cap) if cap else wanted).select("doc_id", "t", F.col("tf").cast("double").alias("tf")).repartition("doc_id").join(index.docs.select("doc_id", norm.alias("norm")), "doc_id").sortWithinPartitions("doc_id")
    schema = T.StructType([terms.schema["qid"], posts.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def summed(docs: pa.Array, t: np.ndarray, part: np.ndarray):
        """Queries, documents and scores of whole documents, some pairs at a time."""
        coded = docs.dictionary_encode()
        doc, of = coded.indices.to_numpy().astype(np.int64), starts[t + 1] - starts[t]
        ends, at = np.cumsum(of), 0
        bounds = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
        while at < len(bounds) - 1:
            lo = bounds[at]
            upto = max(at + 1, int(np.searchsorted(ends[bounds[1:] - 1], ends[lo] - of[lo] + PAIRS, "right")))
            hi, n = bounds[upto], of[lo : bounds[upto]]
            pair = np.repeat(starts[t[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            keys, inverse = np.unique(np.repeat(doc[lo:hi], n) * len(qids) + ask[pair], return_inverse=True)
            yield keys % len(qids), coded.dictionary.take(pa.array(keys // len(qids))), np.bincount(inverse, np.repeat(part[lo:hi], n) * weight[pair], len(keys))
            at = upto

    def run(batches):
        rest, kept, size = None, [], 0
        for batch in chain((b for b in batches if b.num_rows), [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                if rest.num_rows < (1 << 17):
                    continue
            if rest is None or not rest.num_rows:
                continue
            last = rest.num_rows
            if batch is not None:  # the last document may go on
                docs = rest.column("doc_id").combine_chunks()
                last = docs.index(docs[-1]).as_py()
            block, rest = rest.slice(0, last).combine_chunks(), rest.slice(last)
            if not last:
                continue
            tf = block.column("tf").to_numpy()
            for q, d, s in summed(block.column("doc_id").combine_chunks(), block.column("t").to_numpy(), tf * (k1 + 1) / (tf + block.column("norm").to_numpy())):
                kept.append((q, d, s))
                size += len(q)
                if best is None:
                    yield from given(kept)
                    kept, size = [], 0
                elif size > max(PAIRS >> 2, 4 * best * len(qids)):
                    kept = [_first(kept, best)]
                    size = len(kept[0][0])
        if kept:
            yield from given(kept if best is None else [_first(kept, best)])

    def given(kept):
        for q, d, s in kept:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), d, pa.array(s)], names=schema.names)

    return posts.select("doc_id", "t", "tf", "norm").mapInArrow(run, schema)


def _first(kept: list, best: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The rows (query, document, score) that are the first ``best`` of their query in the order of :func:`top`."""
    q, docs, s = np.concatenate([x[0] for x in kept]), pa.concat_arrays([x[1] for x in kept]), np.concatenate([x[2] for x in kept])
    place = np.empty(len(q), np.int64)
    place[pc.sort_indices(docs).to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, -_rounded(s), q))
    q = q[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    within = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    some = order[within < best]
    return q[within < best], docs.take(pa.array(some)), s[some]


def _rounded(s: np.ndarray) -> np.ndarray:
    """To six digits as Spark rounds: half up by the digits that are shown."""
    out = np.round(s, 6)
    near = np.abs(s * 1e6 % 1 - 0.5)
    for i in np.flatnonzero((near < 1e-3) & (np.abs(s) < 1e12)):
        out[i] = float(Decimal(repr(float(s[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def top(scores: DataFrame, limit: int = 100) -> DataFrame:
    """The best ``limit`` documents of each query with their rank; ties by doc_id."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def auto_tags(terms: DataFrame) -> DataFrame:
    """Terms that can serve as tags: of more than one character, in over two documents, with an idf over 2."""
    return terms.where("length(term) > 1 and df > 2 and idf > 2").select(F.col("term").alias("node"))
