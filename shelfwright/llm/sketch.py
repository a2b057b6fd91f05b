"""Document frequencies of a whole corpus in a table of fixed size.

A count sketch of one row: WIDTH counters, each the number of (document, item) pairs whose item hashes there. A count is never
too small, and too large by the average load of a counter at most in expectation. Its size doesn't depend on the corpus, so it
may be broadcast. It is summed in blocks by streaming over shuffled parts, without holding more than one block row in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = 64
SCHEMA = "block int, counts binary"


def count_items(df: DataFrame, slots: Callable[[pa.RecordBatch, np.ndarray], int], width: int) -> tuple[np.ndarray, int]:
    """(counts, number of documents). slots(batch, counts) adds a batch's items to counts, and returns its number of documents.

    Its result is width counters of 8 bytes, whatever the size of df.
    """
    blocks = min(BLOCKS, width)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(width, np.int64), 0
        for b in batches:
            docs += slots(b, counts)
        if docs:
            parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(blocks, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(blocks), -1], pa.int32()), pa.array([*parts, zlib.compress(np.array([docs], np.int64).tobytes())], pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    spread = min(BLOCKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.mapInArrow(local, SCHEMA).repartition(spread, "block").mapInArrow(total, SCHEMA).collect()  # BLOCKS + 1 rows
    by = {r["block"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in rows}
    if not by:
        return np.zeros(width, np.int64), 0
    return np.concatenate([by[k] for k in range(blocks)]), int(by[-1][0])
