"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) of complete runs of equal first `by` columns, for batches in their order; only an open run is carried over."""
    held: list[pa.Table] = []

    def split(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(by):
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        last = [held[-1].column(k)[-1].as_py() for k in range(by)] if held else None
        if last is not None and all(t.column(k)[0].as_py() == last[k] == t.column(k)[-1].as_py() for k in range(by)):
            held.append(t)  # the open run goes on
            continue
        t = pa.concat_tables([*held, t]).combine_chunks()
        starts = split(t)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts[:-1]
        held = [t.slice(starts[-1])]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64)
