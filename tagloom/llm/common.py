"""Shared pieces: tables in the cluster's shared folder, document columns, scanning texts by Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources.workspace import discard, fresh_path, load, shared_dir  # noqa: F401  (the operators take them from here)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    Shuffle files of the finished plan are given back at once, since later steps no longer need them.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._tagloom_path = path
    return out


def scan(df: DataFrame, rows: Callable[[pa.RecordBatch], list | dict | None], schema: str | T.StructType, setup: Callable | None = None, limit: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` where ``rows`` turns a batch into columns for ``schema``.

    ``setup`` runs once per task; its result is the second argument of ``rows``.  Batches come in slices of about
    ``limit`` bytes, less where ``rows`` makes much of each text; the result as a whole must not depend on the slices.
    """
    fields = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for piece in pieces(batch, limit):
                columns = rows(piece, state) if setup else rows(piece)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes, at least one row each, so that Python holds little at a time."""
    if batch.nbytes <= limit or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), limit)
    yield from pieces(batch.slice(half), limit)


def _arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The text column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that no other column of the input can clash with what an operator adds."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))
