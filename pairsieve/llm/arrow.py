"""Arrow batches in portions that bound what a task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most`` bytes of text, or one longer text.

    The rows are copied: string functions of Arrow misread slices that begin inside a batch.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(int(np.searchsorted(ends, before + most, "right")), begin + 1)
            yield batch.take(pa.array(np.arange(begin, end)))
            begin = end
