"""Dictionary matching: all spans of a text that are entries, aligned to units."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import strip, units

#: Most characters of a dictionary that is held as one automaton by every task.
LIMIT_CHARS = 4 << 20


def load_entries(nodes: DataFrame, column: str = "node") -> DataFrame:
    """Different non-blank ``surface`` of nodes, stripped and lower-cased, each with weight 1."""
    return nodes.select(F.lower(strip(column)).alias("surface")).where("surface <> ''").distinct().withColumn("weight", F.lit(1).cast("long"))


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with the weights of ``changes`` in place of their own, new ones added; null weights remove an entry."""
    kept = entries.join(changes.select("surface"), "surface", "left_anti").select("surface", "weight")
    return kept.unionByName(changes.where("weight is not null").select("surface", "weight"))


def lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``surface`` and weight of the asked ones, 0 where there is none."""
    return asked.join(entries, "surface", "left").select("surface", F.coalesce("weight", F.lit(0)).alias("weight"))


def stats(entries: DataFrame) -> DataFrame:
    """num_items, sum_items and log_sum_items, -100 where the sum isn't positive."""
    total = F.coalesce(F.sum("weight"), F.lit(0))
    return entries.agg(F.count("*").alias("num_items"), total.alias("sum_items"), F.when(total > 0, F.log(total.cast("double"))).otherwise(F.lit(-100.0)).alias("log_sum_items"))


def _spans(docs: DataFrame, entries: DataFrame, doc: str, text: Column, limit: int = LIMIT_CHARS) -> DataFrame:
    """doc, first unit, number of units, start and end of every match with its surface (as looked up).

    A dictionary of up to ``limit`` characters goes to every task as one automaton, which passes over each text once;
    a larger one is joined with the units of the texts.  Both give the same rows.
    """
    cut = entries.select("surface", F.size(units("surface")).alias("n"), F.get(units("surface"), 0).alias("head")).where("n > 0").distinct()
    chars, longest = cut.agg(F.sum(F.length("surface")), F.max("n")).first()
    if (chars or 0) <= limit:
        return _by_automaton(docs.select(F.col(doc).alias("doc"), text.alias("text")), [tuple(r) for r in cut.select("surface", "n").collect()])
    return _by_join(docs.select(F.col(doc).alias("doc"), text.alias("text")), cut, longest or 1)


def _by_automaton(docs: DataFrame, entries: list[tuple[str, int]]) -> DataFrame:
    schema = T.StructType([docs.schema["doc"], *T.StructType.fromDDL("i int, start long, n int, surface string, end long").fields])

    def run(batches):
        found = ahocorasick.Automaton()
        for surface, n in entries:
            found.add_word(surface, (surface, n))
        if entries:
            found.make_automaton()
        for batch in batches if entries else ():
            rows, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                # a place between two letters or digits of one run is no border of units
                hits = [(end + 1 - len(s), end + 1, s, n) for end, (s, n) in found.iter(text)] if text else []
                if not hits:
                    continue
                code = np.frombuffer(text.encode("utf-32-le"), "<u4")
                run_ = (code - 48 < 10) | ((code | 32) - 97 < 26)
                border = np.ones(len(code) + 1, bool)
                border[1:-1] = ~(run_[1:] & run_[:-1])
                number = np.cumsum(border)
                hits = [(int(number[a]) - 1, a, n, s, b) for a, b, s, n in hits if border[a] and border[b]]
                rows += [row] * len(hits)
                out += hits
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _by_join(docs: DataFrame, cut: DataFrame, longest: int) -> DataFrame:
    each = docs.withColumn("row", F.monotonically_increasing_id()).select("doc", "row", F.posexplode(units("text")).alias("i", "unit"))
    order = Window.partitionBy("row").orderBy("i")
    before = F.coalesce(F.sum(F.length("unit")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    surfaces, joined = [], F.col("unit")
    for k in range(1, longest + 1):
        if k > 1:
            joined = F.concat(joined, F.lead("unit", k - 1).over(order))  # null past the end
        surfaces.append(F.struct(F.lit(k).alias("n"), joined.alias("surface")))
    placed = each.select("doc", "i", "unit", before.cast("long").alias("start"), F.array(*surfaces).alias("s"))
    # only units that begin an entry go on; an entry is as long as its units
    begun = placed.join(cut.select(F.col("head").alias("unit")).distinct(), "unit", "left_semi")
    found = begun.select("doc", "i", "start", F.explode("s").alias("x")).select("doc", "i", "start", "x.n", "x.surface").where("surface is not null")
    return found.join(cut.select("surface", "n"), ["surface", "n"]).select("doc", "i", "start", "n", "surface", (F.col("start") + F.length("surface")).alias("end"))


def match(docs: DataFrame, entries: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (code points, end exclusive) and surface of all matches, overlapping ones too; case matters."""
    return _spans(docs, entries, doc, F.col(text)).select(F.col("doc").alias(doc), "start", "end", "surface")


def counts(docs: DataFrame, entries: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """How many spans of each surface a document has."""
    return match(docs, entries, doc, text).groupBy(doc, "surface").agg(F.count("*").alias("n"))


def tag(docs: DataFrame, tags: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``tags``, (end_index, tag) of every match in any case, by end and then the longer one first.

    end_index counts units up to the match's end with a space after each; of tags that are equal but for case the
    greatest is given.
    """
    upper = tags.groupBy(F.upper("surface").alias("surface")).agg(F.max("surface").alias("tag"))
    found = _spans(docs, upper, doc, F.upper(text)).join(upper, "surface")
    ended = found.withColumn("end_index", F.col("end") + F.col("i") + F.col("n"))
    ordered = F.sort_array(F.collect_list(F.struct("end_index", (-F.col("n")).alias("k"), "tag")))
    return ended.groupBy(F.col("doc").alias(doc)).agg(F.transform(ordered, lambda x: F.struct(x["end_index"].alias("end_index"), x["tag"].alias("tag"))).alias("tags"))
