"""Packing by powers of two: every document is cut into pieces of binary lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import blocks, give_back, ragged, small_batches, text_values
from rolecall.llm.words import codec_of

#: The id that closes a document.
END_ID = 1

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32()),
])


def piece_lengths(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, pieces per document): whole pieces of `longest` first, then the rest's binary digits, high to low."""
    powers = longest >> np.arange(1, longest.bit_length())
    times = np.concatenate([(tokens // longest)[:, None], (tokens[:, None] & powers) > 0], axis=1).astype(np.int64)
    sizes = np.broadcast_to(np.concatenate([[longest], powers]), times.shape)
    return np.repeat(sizes.ravel(), times.ravel()), times.sum(axis=1)


def _pieces(path: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = text_values(batch.column(1))
            doc = batch.column(0)
            for lo, hi in blocks(texts):
                ids, counts = codec.encode(texts[lo:hi])
                tokens = counts + 1
                closed = np.full(int(tokens.sum()), END_ID, "<u4")
                closed[ragged(np.cumsum(tokens) - tokens, counts)] = ids
                lengths, number = piece_lengths(tokens, longest)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                owner = np.repeat(np.arange(hi - lo), number)
                start = edges[:-1] - (np.cumsum(tokens) - tokens)[owner]
                n = len(lengths)
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(closed)])
                yield pa.RecordBatch.from_arrays([
                    doc.slice(lo, hi - lo).take(pa.array(owner)), pa.array(start), pa.array(lengths), blobs, pa.array(tokens[owner]),
                    pa.array(sequence + np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.log2(lengths).astype(np.int32)),
                ], schema=_ARROW)
                sequence += n
        codec.rest()
        give_back()

    return run


def pack_binary(documents: DataFrame, tokenizer_path: str, longest: int = 2048) -> DataFrame:
    """Pieces of binary lengths; a piece is a sequence of its own, so none is padded and none crosses documents.

    Reads doc_id and text (other columns are ignored) and returns per piece doc_id,
    start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset and bucket (log2 of the length: pieces of a bucket batch together).
    Every document ends with id 1; a null or empty text is that id alone. A row
    without doc_id is packed with a null doc_id, repeated rows are packed each.
    `longest` is a power of two. sequence_id is the partition of the scan and the
    place in it, so it needs no shuffle and comes out alike when a task is rerun.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_pieces(tokenizer_path, longest), _SCHEMA)
