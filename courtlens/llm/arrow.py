"""Small helpers for code that runs in Python workers; it imports nothing that a worker would have to pay for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def rows(batch: pa.RecordBatch, step: int = 128) -> Iterator[list[tuple]]:
    """The rows of a batch as tuples, a few at a time, so that few texts are Python objects at once."""
    for at in range(0, batch.num_rows, step):
        yield list(zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True))


def made(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """A batch of rows that are given as tuples; ``found`` is not empty."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)
