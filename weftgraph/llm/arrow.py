"""Small helpers for operators that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one piece of an Arrow batch that is worked on at a time.
PIECE_ROWS = 2_000


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on pieces of at most PIECE_ROWS rows; a piece may give any number of rows. Empty pieces are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                out = work(batch.slice(at, PIECE_ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def array(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def fixed_bytes(rows) -> pa.Array:
    """A 2-d numpy array as binary values, one per row, without a Python object each."""
    width = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
