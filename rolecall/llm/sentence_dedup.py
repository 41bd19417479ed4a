"""Sliding sentence spans: repeated runs of consecutive pieces of sentences are removed but for their first place.

Sentences are cut into pieces behind words that their hash chooses: of any LONG words
in a row, the smallest. A word is chosen by the LONG - 1 words on its sides alone, so
what two texts share is cut alike in both, wherever its sentences begin and end there,
but for its first and last LONG - 1 words. From every piece a span reaches over at
least RUN pieces and WORDS words. Pieces have at most LONG words, so any 50 words that
two texts share hold a whole span: one begins in the first 2 LONG - 1 words, has at
most WORDS - 1 + LONG, and ends before the last LONG - 1. Spans are named by a hash of their words, dealt by name, and compared across all
documents; the pieces of every span that is not its name's earliest go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolecall.llm.buckets import dealt, gathered, scatter, sent_type
from rolecall.llm.common import blocks, identified, real_id, shuffle_partitions, small_batches, staged, text_bytes, text_values
from rolecall.llm.hashing import RangeHash, mix
from rolecall.llm.spans import INTERVALS, Earliest, merged, pack_intervals, per_document

#: A span has at least so many pieces of sentences and words.
RUN, WORDS = 2, 15
#: Of so many words in a row in a sentence one ends a piece.
LONG = 9
BUCKET_BYTES = 16 << 20
SORT_ROWS = 2_000_000

_U = np.uint64
_I = np.int64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentences(texts: list[bytes]):
    """(names, words, first byte, end byte, per text) of the pieces of some texts' sentences.

    A sentence ends behind a word that ends in `.`, `!` or `?`, at a line end, and
    at the end of the text, a piece also behind a chosen word; its bytes reach to the
    next piece's first word.
    """
    none = np.zeros(0, _I)
    whole = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = _BLANK[whole]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return none.view(_U), none, none, none, np.zeros(len(texts), _I)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(borders, start, "right") - 1
    lowered = np.frombuffer(whole.tobytes().lower(), np.uint8)
    word = RangeHash(lowered).of(start, end)
    lines = np.concatenate([[0], np.cumsum(whole == 10)])
    stop = _STOP[whole[end - 1]]
    stop[:-1] |= (owner[1:] != owner[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    stop[-1] = True

    def closed(stop):
        last = np.flatnonzero(stop)
        first = np.concatenate([[0], last[:-1] + 1])
        return first, last

    first, last = closed(stop)
    ends = np.repeat(last, last - first + 1)
    open_ = np.flatnonzero(np.arange(len(word)) + LONG - 1 <= ends)  # LONG words from here on are in one sentence
    least, chosen = word[open_], open_.copy()
    for k in range(1, LONG):
        other = word[open_ + k]
        smaller = other <= least
        chosen[smaller] = open_[smaller] + k
        np.minimum(least, other, out=least)
    stop[chosen] = True
    first, last = closed(stop)
    name = RangeHash(word).of(first, last + 1)
    own = owner[first]
    begin = start[first] - borders[own]
    finish = np.concatenate([begin[1:], [0]])
    tail = np.concatenate([own[1:] != own[:-1], [True]])
    size = np.diff(borders) - 1
    finish[tail] = size[own[tail]]
    return name, last - first + 1, begin, finish, np.bincount(own, minlength=len(texts))


def _spans(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sub = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = text_values(batch.column(2))
            for lo, hi in blocks(texts):
                name, words, _, _, count = sentences(texts[lo:hi])
                if not len(name):
                    continue
                own = np.repeat(np.arange(hi - lo), count)
                head = np.cumsum(count) - count
                total = np.concatenate([[0], np.cumsum(words)])
                at = np.arange(len(name))
                end = np.maximum(at + RUN, np.searchsorted(total, total[:-1] + WORDS))
                fits = end <= (head + count)[own]
                at, end, own = at[fits], end[fits], own[fits]
                span = mix(RangeHash(name).of(at, end))
                sent = scatter(span, [span, doc[lo + own], sub[lo + own], (at - head[own]).astype(np.int32), (end - at).astype(np.int32)], buckets)
                if sent:
                    yield sent

    return run


def _late(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Earliest(1)
        for entries in gathered(batches, [_U, _I, _I, np.int32, np.int32], SORT_ROWS):
            _, doc, sub, at, size = seen.add(entries)
            packed = pack_intervals(doc, sub, at, at + size, buckets)
            if packed:
                yield packed

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_values(batch.column("text"))
        starts, ends = (batch.column(c).to_pylist() for c in ("starts", "ends"))
        for lo, hi in blocks(texts):
            _, _, begin, finish, count = sentences(texts[lo:hi])
            head = np.cumsum(count) - count
            removed, kept = [], []
            for i, text in enumerate(texts[lo:hi]):
                runs = merged(starts[lo + i], ends[lo + i])
                removed.append(sum(b - a for a, b in runs))
                if runs:
                    cuts = [(int(begin[head[i] + a]), int(finish[head[i] + b - 1])) for a, b in runs]
                    text = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True))
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(count), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "text"],
            )


def remove_repeated_spans(documents: DataFrame) -> DataFrame:
    """Every text without the pieces of repeated spans, the first place of each span staying.

    Reads doc_id and text (other columns are ignored). First is the smallest doc_id,
    then the earliest piece; repeats inside a document count. Words are compared
    with A-Z lower-cased and blanks alike. Returns per row doc_id, n_sentences,
    n_removed (pieces of sentences, as n_sentences) and text. A null text is empty; texts shorter than a span
    stay whole. Rows without doc_id come last; rows equal in doc_id and text are one
    document and each get its result.
    """
    small_batches(documents.sparkSession)
    docs = identified(documents)
    buckets = int(max(shuffle_partitions(docs.sparkSession), text_bytes(docs) // BUCKET_BYTES + 1))
    late = staged(dealt(docs.mapInArrow(_spans(buckets), sent_type(5)), buckets).mapInArrow(_late(buckets), INTERVALS), "spans")
    repeated = staged(per_document(late, buckets), "repeated")
    cut = docs.join(repeated, ["doc_id", "sub"], "left").mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, text string")
    return cut.withColumn("doc_id", real_id())
