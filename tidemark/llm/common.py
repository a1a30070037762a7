"""Shared helpers: tables in the cluster's shared folder and Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, new_path, stored

__all__ = ["discard", "new_path", "ranges", "repeated", "slices", "spread", "stored"]

#: The text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, where few bytes would otherwise meet much work in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def repeated(keyed: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` whose ``key`` occurs twice or more, with the count ``n``, and the table of these keys; both stored.

    Counts are partial sums before their shuffle, and the join is one that Spark can split, so a key
    that a third of all rows have never meets in one task.
    """
    many = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
    return stored(keyed.join(many, "key"), name), many


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows with about ``limit`` bytes in ``column``."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` over all pairs."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
