"""Arrow batches in pieces that bound what a task holds as Python values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sliced(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1024, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and, single longer values aside, ``size`` bytes of a text column."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(max(reach, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
