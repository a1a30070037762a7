"""Python steps whose failures end up beside the results instead of ending the job (DOC-16)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.scratch import stored


def attempted(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tries: int = 3) -> DataFrame:
    """``rows`` with the columns of ``step`` (``schema``, a DDL string) and ``error``, null where it went well.

    ``step`` gets a batch as a pandas frame and gives a frame with a row for each. A batch that raises is tried in halves, down to single rows, and a single
    row ``tries`` times; then its error is written beside it and its own columns are null. So one bad row costs itself, not its batch or the job. The result is not
    stored; ``split`` does so and gives both parts. Names of ``schema`` and ``error`` must be free.
    """
    made = rows.sparkSession.createDataFrame([], schema)
    taken = {*made.columns, "error"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns that are there already: {sorted(taken)}")
    names = made.columns
    arrow = made.toArrow().schema

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        error = None
        for _ in range(tries if batch.num_rows == 1 else 1):
            try:
                out = step(batch.to_pandas())
                if len(out) != batch.num_rows:
                    raise ValueError(f"{len(out)} rows for {batch.num_rows}")
                columns = [pa.Array.from_pandas(out[c], type=arrow.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.nulls(batch.num_rows, pa.string())], [*batch.schema.names, *names, "error"])
                return
            except Exception as e:  # noqa: BLE001  whatever a step raises belongs to the row
                error = f"{type(e).__name__}: {e}"
        if batch.num_rows == 1:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(1, arrow.field(c).type) for c in names), pa.array([error])], [*batch.schema.names, *names, "error"])
            return
        half = batch.num_rows // 2
        yield from of(batch.slice(0, half))
        yield from of(batch.slice(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from of(batch)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rows.schema, *made.schema])
    return rows.mapInArrow(run, f"{fields}, error string")


def split(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters) of ``attempted``: stored once, so that the step runs once for both."""
    kept = stored(done, "attempts")
    return kept.where("error is null").drop("error"), kept.where("error is not null")
