"""Repeated byte strings across documents, removed exactly.

The difference-cover method sorts a covering sample of suffixes, names them,
recurses on the names, and places the remaining suffixes by the sample. A whole
suffix array of the corpus needs several sorts of two thirds of all positions
(over 20 bytes of shuffle for each byte of text), while the question only asks
for equality of prefixes of a fixed length and the earliest place of each. So
the same steps are taken on a sparser cover:

1. Sample: `anchors` covers every window of `length` bytes by a position that
   depends on the window's bytes alone, about one byte in 35.
2. Name: an anchor's names are hashes of its gram and of everything its windows
   see (its context). Entries are dealt by gram name, sorted by both names and
   compared with their neighbours: equal contexts are equal in every window, so
   all but the earliest are repeated there.
3. Recurse: only grams with several different contexts are still open. Their
   earliest contexts' windows, the remaining suffixes, get names of their own,
   are dealt by them, sorted and compared with their neighbours.

Sorts in a task keep one row per name, so a passage that a third of all
documents share is spread over its many names and never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.anchors import anchors
from rolecall.llm.buckets import dealt, gathered, scatter, sent_type
from rolecall.llm.common import blocks, identified, ragged, real_id, shuffle_partitions, small_batches, staged, text_bytes, text_values
from rolecall.llm.hashing import RangeHash, mix
from rolecall.llm.spans import INTERVALS, Earliest, merged, pack_intervals, per_document

#: Bytes hashed to choose an anchor.
GRAM = 32
#: Text for each bucket.
BUCKET_BYTES = 8 << 20
#: Windows looked at in one go; a longer text is walked in such steps.
STEP = 8 << 20
#: Entries sorted at once in a task.
SORT_ROWS = 2_000_000

_U = np.uint64
_I = np.int64


def _sampled(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sub = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = text_values(batch.column(2))
            for lo, hi in blocks(texts):
                edges = np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])])
                whole = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
                step = max(STEP, 1 if hi - lo == 1 else len(whole))
                for at in range(0, max(1, len(whole) - length + 1), step):
                    part = whole[at : at + step + length - 1]
                    ranges, place, first, last, own = anchors(part, edges if hi - lo > 1 else np.array([0, len(part)]), length, GRAM)
                    gram = ranges.of(place, place + GRAM)
                    context = ranges.of(first, last + length) ^ mix((place - first).astype(_U))
                    start = first - edges[own] + at
                    sent = scatter(gram, [gram, context, doc[lo + own], sub[lo + own], start.astype(np.int32), (last - first).astype(np.uint8)], buckets)
                    if sent:
                        yield sent

    return run


def _contexts(length: int, buckets: int):
    """Repeated stretches (kind 0), and window ranges that are still open (kind 1), packed by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Earliest(2)

        def out(kind, doc, sub, start, more, extra):
            packed = pack_intervals(doc, sub, start, start + more.astype(np.int32) + extra, buckets)
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(packed.num_rows, kind, np.int32)), *packed.columns], names=["kind", *packed.schema.names])

        for entries in gathered(batches, [_U, _U, _I, _I, np.int32, np.uint8], SORT_ROWS):
            yield from out(0, *seen.add(entries)[2:], length)
        if seen.kept is not None:
            gram = seen.kept[0]
            several = np.zeros(len(gram), bool)
            several[1:] = gram[1:] == gram[:-1]
            several[:-1] |= several[1:]
            yield from out(1, *(e[several] for e in seen.kept[2:]), 1)

    return run


def _windows(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sub = (np.asarray(batch.column(c)) for c in ("doc_id", "sub"))
            texts = text_values(batch.column("text"))
            opened = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            for lo, hi in blocks(texts):
                lengths = [len(t) for t in texts[lo:hi]]
                edges = np.cumsum([0, *lengths])
                ranges = RangeHash(np.frombuffer(b"".join(texts[lo:hi]), np.uint8))
                first = np.concatenate([a for a, _ in opened[lo:hi]])
                count = np.concatenate([b for _, b in opened[lo:hi]]) - first
                own = np.repeat(np.repeat(np.arange(hi - lo), [len(a) for a, _ in opened[lo:hi]]), count)
                start = ragged(first.astype(_I), count.astype(_I))
                name = ranges.of(start + edges[own], start + edges[own] + length)
                sent = scatter(name, [name, doc[lo + own], sub[lo + own], start.astype(np.int32)], buckets)
                if sent:
                    yield sent

    return run


def _late_windows(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Earliest(1)
        for entries in gathered(batches, [_U, _I, _I, np.int32], SORT_ROWS):
            _, doc, sub, start = seen.add(entries)
            packed = pack_intervals(doc, sub, start, start + length, buckets)
            if packed:
                yield packed

    return run


_KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = text_values(batch.column("text"))
        spans = [merged(a, b) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
        kept = []
        for text, runs in zip(texts, spans, strict=True):
            if runs:
                ends = [0, *(e for _, e in runs)]
                starts = [*(s for s, _ in runs), len(text)]
                text = b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))
            kept.append(text)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[{"start": s, "end": e} for s, e in runs] for runs in spans], kind), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """Every text's UTF-8 bytes without those in a `length`-byte string that also starts earlier.

    Reads doc_id and text (other columns are ignored). Earlier is a smaller doc_id,
    or an earlier start in the same document; matches never cross documents and are
    judged on the input. Returns per row doc_id, n_bytes, spans (maximal removed
    runs) and kept (the remaining bytes). A null text is empty; rows without doc_id
    come last, and rows that share one are ordered by a hash of their text; rows
    equal in both are one document and each get its result. A text of more than
    2 GB is beyond what a column holds.
    """
    if length < GRAM or length - GRAM > 255:
        raise ValueError(f"length must be {GRAM} to {GRAM + 255}")
    small_batches(documents.sparkSession)
    docs = identified(documents)
    buckets = int(max(shuffle_partitions(docs.sparkSession), text_bytes(docs) // BUCKET_BYTES + 1))
    sampled = docs.mapInArrow(_sampled(length, buckets), sent_type(6))
    found = staged(dealt(sampled, buckets).mapInArrow(_contexts(length, buckets), f"kind int, {INTERVALS}"), "contexts")
    opened = staged(per_document(found.filter("kind = 1").drop("kind"), buckets), "open")
    windows = docs.join(opened, ["doc_id", "sub"]).mapInArrow(_windows(length, buckets), sent_type(4))
    late = staged(dealt(windows, buckets).mapInArrow(_late_windows(length, buckets), INTERVALS), "windows")
    repeated = staged(per_document(found.filter("kind = 0").drop("kind").union(late), buckets), "repeated")
    return docs.join(repeated, ["doc_id", "sub"], "left").mapInArrow(_cut, _KEPT).withColumn("doc_id", real_id())
