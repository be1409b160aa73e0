"""Writers of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """All columns of every row, joined by tabs."""
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line for each row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_dict(df: DataFrame, path: str, key: str = "key", value: str = "value", zeros: bool = True) -> None:
    """Key and value of every row; values of zero are left out unless ``zeros``."""
    write_tsv((df if zeros else df.where(F.col(value) != 0)).select(key, value), path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as lines, edges (tp, u, v, w) as a text table, in two folders."""
    write_lines(nodes, "node", f"{path}/nodes")
    write_tsv(edges.select("tp", "u", "v", "w"), f"{path}/edges")


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_graph` has written; weights become numbers again."""
    from tagloom.sources.readers import read_lines, read_tsv

    cols = F.col("cols")
    edges = read_tsv(spark, f"{path}/edges").select(cols[0].alias("tp"), cols[1].alias("u"), cols[2].alias("v"), cols[3].cast("double").alias("w"))
    return read_lines(spark, f"{path}/nodes").select(F.col("line").alias("node")), edges
