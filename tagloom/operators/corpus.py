"""Corpus preparation: segments of documents, and token bags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import plain_tokens, strip
from tagloom.sources.workspace import settle

#: Tokens that are counted at a time.
BLOCK_TOKENS = 1 << 20


def segment(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """id ('name@i') and text of the segments of every document.

    Lines lose white space at their ends.  A blank line (unless the name holds 'pptx') or a line that begins with 15
    dashes ends a segment; its lines are put together with nothing between.  Only segments with lines count.  Runs of
    spaces become two spaces and the ligature for fi two letters.  A fold over a document's lines keeps all in one row.
    """
    slides = F.col(name).cast("string").contains("pptx")
    mark: Column = F.lit("\u0001")
    lines = F.transform(F.split(F.col(text), r"\r\n|\r|\n"), strip)
    cut = F.transform(lines, lambda x: F.when(x.startswith("-" * 15) | ((x == "") & ~slides), mark).otherwise(F.concat(F.lit("\u0002"), x)))
    # a segment is what stands between marks and has a line at least
    parts = F.filter(F.split(F.array_join(cut, ""), "\u0001"), lambda s: s != "")
    clean = F.transform(parts, lambda s: F.replace(F.regexp_replace(F.replace(s, F.lit("\u0002"), F.lit("")), " {2,}", "  "), F.lit("ﬁ"), F.lit("fi")))
    return docs.select(F.col(name).cast("string").alias("_f"), F.posexplode(clean).alias("i", "text")).select(F.concat("_f", F.lit("@"), "i").alias("id"), "text")


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenize=plain_tokens) -> DataFrame:
    """doc, term and tf of every document.

    A row is counted for itself, without an exchange; only rows that share their doc meet afterwards.
    """
    of, same = _shared_ids(docs, doc)
    counted = _row_counts(docs.select(F.col(doc).alias("doc_id"), tokenize(F.col(text)).alias("tokens")))
    if of is None:
        return counted
    return counted.join(of, same, "left_anti").unionByName(counted.join(of, same, "left_semi").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))


def asked_counts(docs: DataFrame, asked: list[str], doc: str = "doc_id", text: str = "text", tokenize=plain_tokens) -> DataFrame:
    """doc, dl and hits (array of term and tf) of every document: the number of all its tokens, and counts of the asked ones.

    As with :func:`token_counts`, only rows that share their doc meet.
    """
    of, same = _shared_ids(docs, doc)
    counted = _row_hits(docs.select(F.col(doc).alias("doc_id"), tokenize(F.col(text)).alias("tokens")), asked)
    if of is None:
        return counted
    some = counted.join(of, same, "left_semi")
    hits = some.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", "h.term").agg(F.sum("h.tf").alias("tf"))
    hits = hits.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("term", "tf")).alias("hits"))
    merged = some.groupBy("doc_id").agg(F.sum("dl").alias("dl")).join(hits, same, "left").select("doc_id", "dl", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"))
    return counted.join(of, same, "left_anti").unionByName(merged)


def _shared_ids(docs: DataFrame, doc: str) -> tuple[DataFrame | None, Column]:
    """Ids (_d) that stand in several rows, None without any, and the condition that doc_id is one."""
    shared = settle(docs.groupBy(F.col(doc).alias("_d")).agg(F.count("*").alias("_n")).where("_n > 1").select("_d"))
    return (shared if shared.limit(1).count() else None), F.col("doc_id").eqNullSafe(F.col("_d"))


def _row_hits(docs: DataFrame, asked: list[str]) -> DataFrame:
    """doc_id, dl and hits of the tokens of each row."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("dl double, hits array<struct<term: string, tf: bigint>>").fields])

    def run(batches):
        names = pa.array(asked, pa.string())
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, ends, at = batch.column(1).flatten(), np.cumsum(size), 0
            while at < len(size):  # some rows at a time, one at least
                begin = int(ends[at] - size[at])
                upto = max(at + 1, int(np.searchsorted(ends, begin + BLOCK_TOKENS, "right")))
                found = pc.index_in(words.slice(begin, int(ends[upto - 1]) - begin), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(upto - at), size[at:upto])
                keys, tf = np.unique((row * len(names) + found)[found >= 0], return_counts=True)
                of = keys // max(1, len(names))
                offsets = pa.array(np.searchsorted(of, np.arange(upto - at + 1)), pa.int32())
                hits = pa.StructArray.from_arrays([names.take(pa.array(keys % max(1, len(names)))), pa.array(tf, pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), pa.array(size[at:upto].astype(float)), pa.ListArray.from_arrays(offsets, hits)], names=schema.names)
                at = upto

    return docs.mapInArrow(run, schema)


def _row_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term and tf of the tokens of each row."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("term string, tf long").fields])

    def run(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, ends, at = batch.column(1).flatten(), np.cumsum(size), 0
            while at < len(size):  # some rows at a time, one at least
                begin = int(ends[at] - size[at])
                upto = max(at + 1, int(np.searchsorted(ends, begin + BLOCK_TOKENS, "right")))
                coded = words.slice(begin, int(ends[upto - 1]) - begin).dictionary_encode()
                n = max(1, len(coded.dictionary))
                keys, tf = np.unique(np.repeat(np.arange(at, upto), size[at:upto]) * n + coded.indices.to_numpy(), return_counts=True)
                for lo in range(0, len(keys), BLOCK_TOKENS >> 3):
                    some = keys[lo : lo + (BLOCK_TOKENS >> 3)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some // n)), coded.dictionary.take(pa.array(some % n)), pa.array(tf[lo : lo + (BLOCK_TOKENS >> 3)])], names=schema.names)
                at = upto

    return docs.mapInArrow(run, schema)


def neighbours(rows: DataFrame, known: list[str]) -> DataFrame:
    """u, v and n: how often two of a few known tokens stand side by side in the rows (one column of tokens).

    A batch is counted at once; its counts, not its places, go on.
    """

    def run(batches):
        names = pa.array(known, pa.string())
        for batch in batches:
            size = pc.list_value_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
            at = pc.index_in(batch.column(0).flatten(), names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            both = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
            keys, n = np.unique(at[:-1][both] * len(known) + at[1:][both], return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // len(known))), names.take(pa.array(keys % len(known))), pa.array(n)], names=["u", "v", "n"])

    return rows.mapInArrow(run, "u string, v string, n long")


def merged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Just the texts, as lines."""
    return docs.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("line"))
