"""Arrow arrays in Python workers, cut so that memory does not follow the batches of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18


def row_sizes(array: pa.Array) -> np.ndarray:
    """Bytes of every row of strings, numbers or lists of them."""
    if pa.types.is_list(array.type):
        counts = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(row_sizes(array.flatten()), dtype=np.int64)))
        return np.diff(ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))])
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    return np.full(len(array), array.type.byte_width)


def small_arrays(batches: Iterator[pa.Array], size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batches' rows in slices of about ``size`` bytes; a longer row is alone."""
    for batch in batches:
        ends = np.cumsum(row_sizes(batch), dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        cuts = np.flatnonzero(np.diff(starts // size)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        for first, last in zip(bounds, bounds[1:]):
            yield batch.slice(first, last - first)
        del batch, ends, starts
        pa.default_memory_pool().release_unused()  # workers live on after their task
