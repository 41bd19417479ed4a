"""Packed shuffles: numpy columns travel in one row per (block, bucket)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64


def sent_type(width: int) -> str:
    return ", ".join(["bucket int", *(f"c{i} binary" for i in range(width))])


def scatter(key: np.ndarray, columns: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """One row per bucket that has entries; entries keep their order, so runs compress."""
    if not len(key):
        return None
    bucket = (key % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    rows = [pa.array(bucket[order[cuts[:-1]]])]
    for column in columns:
        data = np.ascontiguousarray(column[order])
        ends = (cuts * data.itemsize).astype(np.int32)
        rows.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(rows, names=["bucket", *(f"c{i}" for i in range(len(columns)))])


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket")


def gathered(batches: Iterator[pa.RecordBatch], kinds: list[type], limit: int) -> Iterator[list[np.ndarray]]:
    """The entries of the dealt rows, about `limit` at a time."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    waiting = 0
    for batch in batches:
        values = [batch.column(i + 1) for i in range(len(kinds))]
        for r in range(batch.num_rows):
            for part, column, kind in zip(parts, values, kinds, strict=True):
                part.append(np.frombuffer(column[r].as_buffer(), kind))
            waiting += len(parts[0][-1])
            if waiting >= limit:
                yield [np.concatenate(p) for p in parts]
                parts, waiting = [[] for _ in kinds], 0
    if waiting:
        yield [np.concatenate(p) for p in parts]
