"""Small helpers for functions that run over Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gleanworks.session import ship_package

#: Bytes of text that one inner block of a batch function works on; it bounds the size of
#: temporary arrays, never what is read.
BLOCK_BYTES = 1 << 20


#: Rows of the batches that Spark sends to workers, where the session leaves that at Spark's own default: both
#: sides hold whole batches, and functions work on slices of them anyway.
BATCH_ROWS, DEFAULT_ROWS = 2048, "10000"


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over single batches, slices of at most ``rows`` rows at a time."""

    ship_package(df.sparkSession)
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = function(batch.slice(at, rows))
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each value, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_pylist()


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of numbers of a column, as views of its buffer."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in pairwise(ends.tolist())]
    return out
