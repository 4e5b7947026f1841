"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401


def by_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch], batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """f over pieces of the batches whose text column holds about ``most`` bytes at the most, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most:
                yield f(batch.slice(start, i - start))
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield f(batch.slice(start))
