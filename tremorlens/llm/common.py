"""Shared pieces of the text operators: tables, landed intermediates, bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlens.session import shared_dir

#: Characters (UTF-8 bytes, to be exact) that a Python worker holds decoded at a time; one longer text is taken alone.
SLICE_BYTES = 3 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def landed(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_join(big: DataFrame, small: DataFrame, on: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join of ``big`` with ``small`` (one row for each key); rows of ``small`` that are ``hot`` go to every task.

    The caller sees to it that hot rows are few: each stands for at least one ten-thousandth of all rows.
    """
    many = F.broadcast(small.filter(hot))
    rest = big.join(many, on, "left_anti").join(small.filter(~hot), on, how)
    return big.join(many, on).select(rest.columns).union(rest)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts in column ``text`` of one slice hold about ``limit`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null read as empty."""
    return pc.fill_null(column, "").to_pylist()
