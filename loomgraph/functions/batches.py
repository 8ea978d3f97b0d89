"""Arrow batches in bounded slices, for functions that hold their rows as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker holds as objects at once.
STEP_BYTES = 4 << 20


def steps(batch: pa.RecordBatch, column: str | None, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch, each of about `limit` bytes of text and at least one row."""
    if column is None or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)
