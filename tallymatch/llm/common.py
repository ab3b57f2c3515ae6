"""What the operators of this subpackage share: words, digests, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path

#: ASCII white space, the only characters that part words.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for a null or empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null where the key is null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cut lineage that outlives an executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a worker has freed to the system: workers outlive their stage, and would hold it beside the next one's."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], *columns: int, size: int = 1 << 22, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches without empty ones, cut so that the binary columns have about size bytes, or one row, at most.

    A worker starts on them without what its last task has freed.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = min(max(int(np.searchsorted(ends, before + size, "right")), begin + 1), begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
