"""Shared pieces of the operators: Arrow batches of texts, and column handling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch of texts; a batch is held whole, so it is kept small for very long texts.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of few rows, since texts may be very long. A worker gives free memory back when a task ends."""

    def released(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(released, schema)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that clash with an operator's output columns (names compare without case)."""
    out = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


#: Rows of 16 bytes that are broadcast at most; beyond, the join shuffles.
MOST_BROADCAST = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A narrow table to join with: broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table has not (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
