"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices, so that only few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapper(one: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            yield one(batch)

    return run
