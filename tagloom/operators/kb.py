"""Lookups in a knowledge base of tables: mentions (m, e, pos), triples (s, p, o, pos), types (e, type), isa (e, concept,
score) and clicks (e, n).  Each takes a table of what is asked for and answers with a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BORN, DIED, AGE, YEARS = "出生日期", "逝世日期", "年龄", "岁"
CATEGORY, DESCRIPTION = "CATEGORY_ZH", "DESC"


def _list(value: str, order: str) -> Column:
    """Values of a group as an array in order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])


def entities_of(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """m and its entities, first ones first."""
    return asked.select("m").distinct().join(mentions, "m").groupBy("m").agg(_list("e", "pos").alias("entities"))


def mentions_of(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """e and its mentions."""
    return asked.select("e").distinct().join(mentions, "e").groupBy("e").agg(F.array_sort(F.collect_list("m")).alias("mentions"))


def description_of(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """e and its first description, '' without one."""
    first = triples.where(F.col("p") == DESCRIPTION).groupBy(F.col("s").alias("e")).agg(F.min_by("o", "pos").alias("description"))
    return asked.select("e").distinct().join(first, "e", "left").select("e", F.coalesce("description", F.lit("")).alias("description"))


def values_of(asked: DataFrame, triples: DataFrame, attribute: str) -> DataFrame:
    """e and its values of an attribute, in order; entities without any are left out."""
    return asked.select("e").distinct().join(triples.where(F.col("p") == attribute).withColumnRenamed("s", "e"), "e").groupBy("e").agg(_list("o", "pos").alias("values"))


def categories_of(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """e and its categories."""
    return values_of(asked, triples, CATEGORY)


def types_of(asked: DataFrame, types: DataFrame) -> DataFrame:
    """e and its types."""
    return asked.select("e").distinct().join(types, "e").groupBy("e").agg(F.array_sort(F.collect_list("type")).alias("types"))


def properties_of(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """e, p and the list of values of p."""
    return asked.select("e").distinct().join(triples.withColumnRenamed("s", "e"), "e").groupBy("e", "p").agg(_list("o", "pos").alias("values"))


def inverse_of(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """e, p, s of the triples whose object is the entity."""
    return asked.select("e").distinct().join(triples.select(F.col("o").alias("e"), "p", "s"), "e")


def clicks_of(asked: DataFrame, clicks: DataFrame) -> DataFrame:
    """e and its popularity, 0 without any."""
    return asked.select("e").distinct().join(clicks, "e", "left").select("e", F.coalesce("n", F.lit(0)).alias("n"))


def ages(triples: DataFrame, year: int) -> DataFrame:
    """s, p, o with the age in ``year`` of everything with a date of birth and none of death."""
    known = triples.groupBy("s").agg(F.bool_or(F.col("p") == DIED).alias("dead"), F.min(F.when(F.col("p") == BORN, F.regexp_extract("o", r"(\d{4})", 1))).alias("born"))
    alive = known.where("not dead and born <> ''")
    return alive.select("s", F.lit(AGE).alias("p"), F.concat((F.lit(year) - F.col("born").cast("int")).cast("string"), F.lit(YEARS)).alias("o"))


def triples_of(asked: DataFrame, triples: DataFrame, year: int, links: bool = False) -> DataFrame:
    """e, p, o of the entities with derived ages; markup of links is taken out of values unless ``links``."""
    mine = triples.join(asked.select(F.col("e").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o")
    plain = mine if links else mine.withColumn("o", F.regexp_replace("o", r"<a.+?>(.+?)</a>", "$1"))
    return plain.unionByName(ages(mine, year)).withColumnRenamed("s", "e")


def concepts_of(asked: DataFrame, isa: DataFrame) -> DataFrame:
    """e and its concepts, surest first."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "concept")))
    return asked.select("e").distinct().join(isa, "e").groupBy("e").agg(F.transform(order, lambda x: x["concept"]).alias("concepts"))


def scored_concepts_of(asked: DataFrame, isa: DataFrame) -> DataFrame:
    """e, concept and score."""
    return asked.select("e").distinct().join(isa, "e").select("e", "concept", "score")


def entities_with(asked: DataFrame, isa: DataFrame) -> DataFrame:
    """concept and its entities."""
    return asked.select("concept").distinct().join(isa, "concept").groupBy("concept").agg(F.array_sort(F.collect_list("e")).alias("entities"))


def is_entity(asked: DataFrame, mentions: DataFrame) -> DataFrame:
    """m and whether it names any entity."""
    known = mentions.select("m").distinct().withColumn("hit", F.lit(True))
    return asked.select("m").distinct().join(known, "m", "left").select("m", F.coalesce("hit", F.lit(False)).alias("is_entity"))
