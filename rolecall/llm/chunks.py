"""Texts cut where tokenizers that keep their blanks always cut: before a space behind a visible character.

What a tokenizer makes of a chunk does not depend on its neighbours, so a worker
remembers it. Chunks are known by 64-bit hashes of their bytes, their space included.
"""

from __future__ import annotations

import numpy as np

from rolecall.llm.common import ragged
from rolecall.llm.hashing import RangeHash
from rolecall.llm.words import Places

#: Chunks a worker remembers; beyond it keeps the KEPT it met most often.
REMEMBERED, KEPT = 800_000, 150_000

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
# Blanks beyond ASCII end in one of these bytes behind one of those.
_LAST, _BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEFORE[[0x80, 0x81, 0x9A, 0xC2]] = True


def chunk_starts(buffer: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Ascending starts of the chunks of texts that stand end to end in `buffer`; empty texts have none."""
    cut = buffer == 32
    cut[1:] &= ~_BLANK[buffer[:-1]]
    cut[2:] &= ~(_LAST[buffer[1:-1]] & _BEFORE[buffer[:-2]])
    cut[text_starts[text_starts < len(buffer)]] = True
    return np.flatnonzero(cut)


class KeyedLists:
    """A list of numbers for each 64-bit key; lets go of rare keys when it is full."""

    def __init__(self, kind: type = np.int32):
        self.kind = kind
        self._set(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))

    def _set(self, keys: np.ndarray, count: np.ndarray, values: np.ndarray, met: np.ndarray) -> None:
        self.keys, self.count, self.values, self.met = keys, count, values, met
        self.start = np.cumsum(count) - count
        self.places = Places(max(2 * len(keys), 1 << 16))
        self.places.add(keys, np.arange(len(keys), dtype=np.int32))

    def trim(self, most: int = KEPT) -> np.ndarray:
        """Keep the `most` keys met most often; returns their former codes."""
        kept = np.sort(np.argsort(self.met, kind="stable")[max(0, len(self.met) - most) :])
        self._set(self.keys[kept], self.count[kept], self.of(kept)[0], self.met[kept])
        return kept

    def add(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Different keys that are not there yet."""
        known = len(self.keys)
        if 2 * (known + len(keys)) > len(self.places.keys):
            self.places = Places(2 * (known + len(keys)))
            self.places.add(self.keys, np.arange(known, dtype=np.int32))
        self.places.add(keys, np.arange(known, known + len(keys), dtype=np.int32))
        self.start = np.concatenate([self.start, len(self.values) + np.cumsum(counts) - counts])
        self.keys, self.count = np.concatenate([self.keys, keys]), np.concatenate([self.count, counts])
        self.values = np.concatenate([self.values, values.astype(self.kind, copy=False)])
        self.met = np.concatenate([self.met, np.zeros(len(keys), np.int64)])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all codes one after the other, values per code)."""
        counts = self.count[codes]
        return self.values[ragged(self.start[codes], counts)], counts


class CodedLists:
    """Lists of numbers known by the order in which they were added."""

    def __init__(self):
        self.counts, self.values, self.one = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
        self.size = 0

    def add_one(self, value: int) -> int:
        """The code of a list of one number."""
        self.one.append(value)
        self.size += 1
        return self.size - 1

    def _settle(self) -> None:
        self.counts.append(np.ones(len(self.one), np.int64))
        self.values.append(np.array(self.one, np.int32))
        self.one = []

    def add(self, values: np.ndarray, counts: np.ndarray) -> int:
        """The code of the first of len(counts) lists."""
        self._settle()
        self.counts.append(counts)
        self.values.append(values)
        self.size += len(counts)
        return self.size - len(counts)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all codes one after the other, values per code)."""
        self._settle()
        self.counts, self.values = [np.concatenate(self.counts)], [np.concatenate(self.values)]
        start = np.cumsum(self.counts[0]) - self.counts[0]
        counts = self.counts[0][codes]
        return self.values[0][ragged(start[codes], counts)], counts


def chunk_codes(table: KeyedLists, texts: list[bytes], learn, forget=None) -> tuple[np.ndarray, np.ndarray]:
    """(code of every chunk of the texts, chunks per text).

    `learn(chunks)` gives (values, counts) of chunks that are not in the table, and
    `forget(codes)` hears which codes stay, in order, when rare ones leave it.
    """
    whole = b"".join(texts)
    buffer = np.frombuffer(whole, np.uint8)
    edges = np.cumsum([0, *map(len, texts)])
    start = chunk_starts(buffer, edges[:-1])
    per_text = np.diff(np.searchsorted(start, edges))
    end = np.append(start[1:], len(buffer))[: len(start)]
    keys = RangeHash(buffer).of(start, end)
    keys += keys == 0
    codes = table.places.find(keys)
    missing = np.flatnonzero(codes < 0)
    if len(missing):
        fresh, first = np.unique(keys[missing], return_index=True)
        if len(table.keys) + len(fresh) > REMEMBERED and len(table.keys) > KEPT:
            kept = table.trim()
            if forget:
                forget(kept)
            return chunk_codes(table, texts, learn, forget)
        at = missing[first]
        table.add(fresh, *learn([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
        codes[missing] = table.places.find(keys[missing])
    table.met += np.bincount(codes, minlength=len(table.met))
    return codes.astype(np.int64), per_text
