"""Bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` (of strings) has about ``most`` bytes in each; one longer text makes a slice
    of its own. So a worker's memory does not depend on how many rows Spark puts into a batch."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if not len(text):
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64))
        at = 0
        while at < len(text):
            done = size[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(size, done + most, "right"))), at + (1 << 16))
            yield batch.slice(at, to - at)
            at = to
