"""Group-wise work on sorted partitions, without one Python call and Arrow stream for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` integer columns of a sorted partition, one table a run.

    Only the open run is held; callers bound its size by the keys that they deal by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), n]
        for a, b in zip(cuts, cuts[1:]):
            if held and (k[a] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)
