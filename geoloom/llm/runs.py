"""Runs of equal keys in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first n_keys integer columns; runs may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            key = tuple(k[low] for k in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)
