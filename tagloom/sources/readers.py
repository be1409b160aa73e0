"""Readers of text tables.  Lines keep the order of their file through (file, block, number) positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import is_blank, strip

#: Schema of a search log; results hold what a result page showed, in order.
LOG_RESULT = "title string, url string, bm25 double, doc_type string, modified double, features map<string,double>"


def read_lines(spark: SparkSession, path: str, blanks: bool = False) -> DataFrame:
    """``line`` and ``pos`` of every line of one or more files; empty lines are left out unless ``blanks``."""
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("line"), F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"))
    return raw if blanks else raw.where("line <> ''")


def read_stripped(spark: SparkSession, path: str) -> DataFrame:
    """Every line without white space at its ends, empty ones included."""
    return read_lines(spark, path, True).withColumn("line", strip("line"))


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """The different lines."""
    return read_lines(spark, path).select("line").distinct()


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``cols`` (as many as the line has) and ``pos`` of every line; nothing is quoted."""
    return read_lines(spark, path, True).select(F.split("line", "\t").alias("cols"), "pos")


def cells(rows: DataFrame, arity: int) -> DataFrame:
    """Columns _c0, _c1 ... of a ragged table; short rows are filled with nulls."""
    return rows.select(*(F.get("cols", i).alias(f"_c{i}") for i in range(arity)))


def read_dict(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """``key`` and ``value``: lines cut at the first tab, the value cast; of repeated keys the last line holds."""
    part = read_lines(spark, path).select(F.split("line", "\t", 2).alias("p"), "pos").where("size(p) = 2")
    return part.groupBy(F.col("p")[0].alias("key")).agg(F.max_by(F.col("p")[1], "pos").cast(kind).alias("value"))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON lines; lines that aren't JSON are left out."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*full.fields, T.StructField("_bad", T.StringType())])
    parsed = read_lines(spark, path).select(F.from_json("line", marked, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def read_search_log(spark: SparkSession, path: str, schema: str | T.StructType, repeat_last: bool = False) -> DataFrame:
    """Impressions of a search log.

    Lines that don't parse are left out; with ``repeat_last`` each counts as its predecessor once more, as training does.
    """
    if not repeat_last:
        return read_json_lines(spark, path, schema)
    from pyspark.sql import Window

    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*full.fields, T.StructField("_bad", T.StringType())])
    parsed = read_lines(spark, path).select("pos", F.from_json("line", marked, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.when(F.col("r._bad").isNull(), F.col("r"))
    order = Window.partitionBy("pos.file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return parsed.select(F.last(good, ignorenulls=True).over(order).alias("r")).where("r is not null").select("r.*").drop("_bad")


def click_groups(rows: DataFrame) -> DataFrame:
    """uid, query and the clicked (title, url) of a click table (``cols``); lines with a blank query are left out.

    Lines with fewer than five cells are an error.
    """
    need = F.when(F.size("cols") >= 5, F.col("cols")).otherwise(F.raise_error(F.lit("a click line has fewer than five cells")))
    five = rows.select(need.alias("c"))
    named = five.select(*(F.col("c")[i].alias(n) for i, n in enumerate(("uid", "query", "intention", "title", "url"))))
    return named.where(~is_blank("query")).groupBy("uid", "query").agg(F.sort_array(F.collect_list(F.struct("title", "url"))).alias("clicks"))


def index_source_tsv(rows: DataFrame) -> DataFrame:
    """doc_id and text of a table to be indexed: the first and the last cell."""
    return rows.select(F.element_at("cols", 1).alias("doc_id"), F.element_at("cols", -1).alias("text"))


def index_source_fields(docs: DataFrame, doc_id: str, weights: dict[str, float], tokenize) -> DataFrame:
    """doc_id, term and tf of records whose fields count with different weights for each occurrence of a term."""
    parts = F.array(*(F.struct(F.lit(w).cast("double").alias("w"), tokenize(F.col(c)).alias("terms")) for c, w in weights.items()))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.w", F.explode("p.terms").alias("term"))
    return each.groupBy("doc_id", "term").agg(F.sum("w").alias("tf"))


def index_source_dir(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of every readable file below a folder.

    Of the text only newlines, tabs, spaces and Chinese letters are kept; the path itself is searchable too.
    """
    files = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    name: Column = F.col("_metadata.file_path")
    return files.select(name.alias("doc_id"), F.concat(F.regexp_replace("value", "[^\\n\\t 一-龥]", ""), F.lit("\n"), name).alias("text"))
