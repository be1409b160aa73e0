"""The text-table toolbox: relational verbs on lines and ragged rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.sources.workspace import settle
from tagloom.sources.writers import write_tsv


#: Most rows of the right side of a product.
PRODUCT_ROWS = 100_000


def rows_in_set(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the values (first column of ``values``); repeated rows stay."""
    return rows.join(values.select(F.col(values.columns[0]).alias("_v")).distinct(), F.col(column) == F.col("_v"), "left_semi")


def merge(*tables: DataFrame) -> DataFrame:
    """All rows of all tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the given order without meeting in one task: places within ranges, plus the ranges' starts.

    The ranges are written once, so that both sides of the sum see the same ones whatever the planner makes of them.
    Ties are spread over ranges, and ordered, by a hash of the other columns.
    """
    tie = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    ranges = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).withColumn("_id", F.monotonically_increasing_id())
    ranges = settle(ranges).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_size"))  # as many rows as there are ranges
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_id", "_start")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows side by side by their number, as many as the shorter side has."""
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n").drop("_n")


def distinct_rows(rows: DataFrame, column: str) -> DataFrame:
    """Different non-empty lines."""
    return rows.where(F.col(column) != "").select(column).distinct()


def split_by_arity(rows: DataFrame, limit: int = 3) -> dict[int, DataFrame]:
    """Rows (``cols``) by their number of cells; refused if there are more than ``limit`` numbers."""
    found = [r[0] for r in rows.select(F.size("cols").alias("n")).distinct().orderBy("n").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"rows have more than {limit} different numbers of cells")
    return {n: rows.where(F.size("cols") == n) for n in found}


def sort_rows(rows: DataFrame, column: int, kind: str = "int", descending: bool = True) -> DataFrame:
    """Rows (``cols``) with more than ``column`` cells by that cell as a number, then by all cells."""
    key = F.col("cols")[column].cast(kind)
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return rows.where(F.size("cols") > column).orderBy(way(key), way(F.col("cols")))


def sample_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, or all if there are fewer; the same for the same seed and rows."""
    key = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in rows.columns))
    return rows.withColumn("_k", key).orderBy("_k", *(F.col(f"`{c}`") for c in rows.columns)).limit(n).drop("_k")


def set_product(left: DataFrame, right: DataFrame, a: str, b: str, name: str = "line") -> DataFrame:
    """All concatenations of a value of one side with one of the other; the right side is a short list.

    Its length is checked, since the result has as many rows as both lengths multiplied.
    """
    if right.limit(PRODUCT_ROWS + 1).count() > PRODUCT_ROWS:
        raise ValueError(f"the right side of a product has more than {PRODUCT_ROWS} rows")
    return left.select(a).crossJoin(right.select(b)).select(F.concat(a, b).alias(name))


def by_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows by value, largest first; ties by key."""
    return df.orderBy(F.col(value).desc(), F.col(key).asc())


_CLAUSE = re.compile(r"\b(select|from|to|where)\b")


def parse_command(command: str) -> dict[str, str]:
    """Clauses of ``select a, b from x+y where p to z``.

    All but quoted texts is lower-cased; clauses may stand in any order.  where is 'true' and to is 'temp.txt' unless given.
    """
    kept: list[str] = []

    def hold(m: re.Match) -> str:
        kept.append(m[0].lower())
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"\"[^\"]*\"|'[^']*'", hold, command).lower()
    parts = _CLAUSE.split(text)
    clauses = {k: v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}
    restore = lambda s: re.sub("\0(\\d+)\0", lambda m: "'" + kept[int(m[1])][1:-1].replace("'", "\\'") + "'", s)
    return {"where": "true", "to": "temp.txt"} | {k: restore(v) for k, v in clauses.items()}


def run_command(tables: dict[str, DataFrame], command: str) -> DataFrame:
    """Rows of a command over named ragged tables (``cols``).

    ``x[i]`` is cell i of a row; conditions and columns are SQL expressions, never code.  Sources joined by + are put
    one after another.  There is no grouping, joining or ordering.
    """
    c = parse_command(command)
    rows = merge(*(tables[n.strip()].select("cols") for n in c["from"].split("+")))
    cell = lambda s: re.sub(r"\bx\s*\[\s*(\d+)\s*\]", r"get(cols, \1)", s)
    chosen: list[Column] = [F.expr(cell(p)).cast("string").alias(f"c{i}") for i, p in enumerate(_top_level(c["select"]))]
    return rows.where(F.expr(cell(c["where"]))).select(*chosen)


def save_command(tables: dict[str, DataFrame], command: str, folder: str) -> str:
    """Write the rows of a command as a text table under the name of its ``to`` in ``folder``; the path is returned."""
    path = f"{folder.rstrip('/')}/{parse_command(command)['to'].strip().replace('/', '_')}"
    write_tsv(run_command(tables, command), path)
    return path


def _top_level(text: str) -> list[str]:
    """Parts between commas that aren't within brackets or quotes."""
    out, depth, quoted, part = [], 0, False, ""
    for ch in text:
        quoted ^= ch == "'"
        depth += (ch in "([") - (ch in ")]") if not quoted else 0
        if ch == "," and depth == 0 and not quoted:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]
