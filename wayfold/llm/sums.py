"""Sums of arrays over all rows: in each task, then in a few groups, then on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

GROUPS = 32
_ROW = pa.schema([("g", pa.int32()), ("c", pa.binary())])


def _total(arrays: Iterable[np.ndarray]) -> np.ndarray:
    out = np.zeros(0, dtype=np.int64)
    for c in arrays:
        if len(c) > len(out):
            out, c = np.array(c, dtype=np.int64), out
        out[: len(c)] += c
    return out


def summed(df: DataFrame, counts: Callable[[Iterable[pa.RecordBatch]], Iterable[np.ndarray]]) -> np.ndarray:
    """The sum of the integer arrays that counts() yields from the batches of all tasks; shorter ones are as if filled with 0.

    The arrays' length must have a bound of its own (bins, vocabulary): one array leaves each task
    and GROUPS of them reach the driver, however many rows there are.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _total(counts(batches))
        if len(got):
            yield pa.RecordBatch.from_pydict({"g": [TaskContext.get().partitionId() % GROUPS], "c": [got.tobytes()]}, schema=_ROW)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _total(np.frombuffer(x.as_py(), dtype=np.int64) for b in batches for x in b.column("c"))
        if len(got):
            yield pa.RecordBatch.from_pydict({"g": [0], "c": [got.tobytes()]}, schema=_ROW)

    rows = df.mapInArrow(each, "g int, c binary").repartition(GROUPS, "g").mapInArrow(merge, "g int, c binary").collect()
    return _total(np.frombuffer(bytes(r.c), dtype=np.int64) for r in rows)
