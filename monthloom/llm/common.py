"""Shared folder, stored intermediate tables, and Arrow batches of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from monthloom.session import shared_folder

#: Text handled at a time inside a task; bounds the arrays derived from a batch.
SLICE_BYTES = 4_000_000


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, which outlasts executors; cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(spark: SparkSession, value):
    """A function that gives ``value`` inside tasks: broadcast together with the code of its class."""
    from pyspark import cloudpickle

    known = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        import pickle

        return pickle.loads(known.value)

    return get


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, one row at least."""
    rows, a = len(offsets) - 1, 0
    while a < rows:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), rows)
        yield a, b
        a = b


def sliced(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut into row ranges of bounded text, with the text's bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, off = text_buffers(batch.column(column))
        for a, b in row_slices(off, limit):
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
