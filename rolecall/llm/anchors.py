"""Content-chosen positions that every window of a text contains.

Two equal windows choose the same position relative to their start, wherever
they stand: the covering property that a difference cover gives for positions.
"""

from __future__ import annotations

import numpy as np

from rolecall.llm.hashing import RangeHash

_U = np.uint64


def anchors(buffer: np.ndarray, edges: np.ndarray, width: int, gram: int):
    """(ranges, at, low, high, text) of the anchors of every window of `width` bytes inside a text.

    `buffer` holds the texts one after the other with borders `edges`. A window's
    anchor is the start of its least `gram`-byte hash, the first of equals. For
    each anchor: its place, the first and last window that choose it, and its text.
    """
    ranges = RangeHash(buffer)
    n = len(buffer)
    if n < width:
        return ranges, *(np.zeros(0, np.int64),) * 4
    span = width - gram + 1
    place = np.arange(n - gram + 1)
    bits = _U(max(1, int(n).bit_length()))
    best = ((ranges.of(place, place + gram) >> bits) << bits) | place.astype(_U)
    reach = 1
    while 2 * reach <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < span:
        best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: n - width + 1]
    start = np.flatnonzero(np.arange(n - width + 1) + width <= edges[text + 1])
    chosen = (best[start] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    owner = text[start]
    if not len(start):
        return ranges, *(np.zeros(0, np.int64),) * 4
    fresh = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([fresh[1:], [len(start)]]) - 1
    return ranges, chosen[fresh], start[fresh], start[last], owner[fresh]
