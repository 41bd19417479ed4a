"""Earliest occurrences of keys, and intervals gathered per document, by packed shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolecall.llm.buckets import dealt, gathered, scatter, sent_type
from rolecall.llm.hashing import mix

_U = np.uint64
_I = np.int64

#: Packed intervals: document, sub, start, end, sent to the document's bucket.
INTERVALS = sent_type(4)


def doc_key(doc: np.ndarray, sub: np.ndarray) -> np.ndarray:
    return mix(doc.view(_U) ^ mix(sub.view(_U)))


def pack_intervals(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    columns = [np.ascontiguousarray(doc, _I), np.ascontiguousarray(sub, _I), start.astype(np.int32), end.astype(np.int32)]
    return scatter(doc_key(columns[0], columns[1]), columns, buckets)


class Earliest:
    """Keeps each key's first entry by (document, sub, place) and gives back the others.

    Entries are lists of columns: `keys` key columns, then document, sub, place,
    then any others. What is kept grows with the different keys of a task, not
    with the entries, so a key that every document holds costs one row.
    """

    def __init__(self, keys: int):
        self.keys = keys
        self.kept: list[np.ndarray] | None = None

    def add(self, entries: list[np.ndarray]) -> list[np.ndarray]:
        if self.kept is not None:
            entries = [np.concatenate([a, b]) for a, b in zip(self.kept, entries, strict=True)]
        k = self.keys
        order = np.lexsort(tuple(reversed(entries[: k + 3])))
        entries = [e[order] for e in entries]
        n = len(order)
        first, fresh = np.zeros(n, bool), np.zeros(n, bool)
        first[:1] = True
        for e in entries[:k]:
            first[1:] |= e[1:] != e[:-1]
        fresh[:] = first
        for e in entries[k : k + 3]:
            fresh[1:] |= e[1:] != e[:-1]
        late = fresh & ~first  # an entry equal to the first is the first, repeated
        self.kept = [e[first] for e in entries]
        return [e[late] for e in entries]


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc, sub, start, end in gathered(batches, [_I, _I, np.int32, np.int32], 1 << 62):
        order = np.lexsort((start, sub, doc))
        doc, sub, start, end = doc[order], sub[order], start[order], end[order]
        cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]))
        offsets = np.concatenate([cuts, [len(doc)]]) * 4
        lists = [pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in (start, end)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), pa.array(sub[cuts]), *lists], names=["doc_id", "sub", "starts", "ends"])


def per_document(intervals: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, sub, starts, ends): each document's intervals by start, as packed 32-bit numbers."""
    return dealt(intervals, buckets).mapInArrow(_per_document, "doc_id long, sub long, starts binary, ends binary")


def merged(starts: bytes | None, ends: bytes | None) -> list[tuple[int, int]]:
    """Maximal runs that intervals sorted by start cover; touching intervals are one run."""
    if not starts:
        return []
    start, reach = np.frombuffer(starts, np.int32), np.maximum.accumulate(np.frombuffer(ends, np.int32))
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    tails = np.concatenate([heads[1:] - 1, [len(start) - 1]])
    return list(zip(start[heads].tolist(), reach[tails].tolist(), strict=True))
