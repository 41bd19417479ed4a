"""Distinct word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from rolecall.llm.common import ragged
from rolecall.llm.hashing import RangeHash


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each text's distinct shingles, sorted, one text after the other.

    Words are runs of anything but the six ASCII blanks, A-Z lower-cased; a text
    with fewer than `width` words has its whole sequence as one shingle, a text
    without words has none.
    """
    words = [t.lower().split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(texts), np.int64)
    if not n_words.sum():
        return np.zeros(0, np.uint64), counts
    buffer = np.frombuffer(b" ".join(b" ".join(w) for w in words if w), np.uint8)
    blanks = np.flatnonzero(buffer == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(buffer)]])
    size = np.minimum(n_words, width)
    number = np.where(n_words > 0, n_words - size + 1, 0)
    first = ragged(np.cumsum(n_words) - n_words, number)
    last = first + np.repeat(size, number) - 1
    hashes = RangeHash(buffer).of(starts[first], ends[last])
    edges = np.concatenate([[0], np.cumsum(number)])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[edges[:-1][number > 0]] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], total[edges[1:]] - total[edges[:-1]]
