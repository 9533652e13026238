"""Arrow batches cut by the bytes of their texts, so that no step holds ten thousand long ones at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20


def by_bytes(batches, column: int, limit: int = SLICE_BYTES):
    """The rows of Arrow batches in order, as slices of about ``limit`` bytes in a string or binary
    column. A longer text is a slice of its own; an empty batch gives none."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], dtype=_offset_type(batch.column(column)))[
            batch.column(column).offset:batch.column(column).offset + batch.num_rows + 1].astype(np.int64)
        ) if batch.num_rows else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _offset_type(column: pa.Array):
    return np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
