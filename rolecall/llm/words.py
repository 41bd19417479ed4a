"""Token ids of whole texts, word by word through a bounded table."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from rolecall.llm.common import ragged
from rolecall.llm.hashing import RangeHash

#: Words a worker remembers, about 50 bytes each; beyond it keeps the KEPT it met most often.
REMEMBERED, KEPT = 800_000, 150_000
#: Unknown words that are encoded as one text, and texts that are encoded at once.
TOGETHER, AT_ONCE = 1_000, 16

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
# Letters, each of one code point before and after lower-casing, and at most one stop behind them: one or two pieces.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")


class Places:
    """Places of 64-bit keys in an open table of numpy arrays; key 0 stands for an empty slot."""

    def __init__(self, size: int):
        self.mask = _U((1 << (2 * size).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, _U)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of every key, -1 where it has none."""
        slot = (keys & self.mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held, wanted = self.keys[slot[open_]], keys[open_]
            hit = held == wanted
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that are not there yet."""
        slot = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = left[self.values[slot[left]] != values[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


class WordCodec:
    """Encodes texts with a tokenizer that drops white space and marks word ends, so that words can be encoded on their own.

    Words are known by 64-bit hashes of their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)], bool)
        self._set(np.zeros(0, _U), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _set(self, keys: np.ndarray, count: np.ndarray, ids: np.ndarray, met: np.ndarray) -> None:
        self.keys, self.count, self.ids, self.met = keys, count, ids, met
        self.start = (np.cumsum(count) - count).astype(np.int32)
        self.places = Places(max(2 * len(keys), 1 << 16))
        self.places.add(keys, np.arange(len(keys), dtype=np.int32))

    def rest(self) -> None:
        """Between tasks only the most frequent words stay: the worker's memory is wanted for other work."""
        if len(self.keys) > KEPT:
            self._trim()

    def _trim(self) -> None:
        kept = np.sort(np.argsort(self.met, kind="stable")[-KEPT:])
        ids = self.ids[ragged(self.start[kept].astype(np.int64), self.count[kept].astype(np.int64))]
        self._set(self.keys[kept], self.count[kept], ids, self.met[kept])

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts that are encoded each on its own."""
        parts, counts = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), AT_ONCE):  # an encoding takes much more room than its ids
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
            counts += map(len, lists)
            parts.append(np.fromiter(chain.from_iterable(lists), np.uint32, sum(counts[at:])))
        return np.concatenate(parts), np.array(counts, np.int32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Plain words are encoded many at a time; the marks of word ends tell them apart again."""
        texts = [w.decode() for w in words]
        plain = np.fromiter((_PLAIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        at, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        pieces = np.array([1 if texts[i][-1].isalpha() else 2 for i in at], np.int64)
        ids, _ = self._encoded([" ".join([texts[i] for i in at[k : k + TOGETHER]]) for k in range(0, len(at), TOGETHER)])
        last = np.flatnonzero(self.ends[ids])[np.cumsum(pieces) - 1] if len(at) else np.zeros(0, np.int64)
        more, sizes = self._encoded([texts[i] for i in other])
        counts = np.concatenate([np.diff(np.concatenate([[-1], last])), sizes]).astype(np.int32)
        order, known = np.concatenate([at, other]), len(self.keys)
        if 2 * (known + len(order)) > len(self.places.keys):
            self.places = Places(2 * (known + len(order)))
            self.places.add(self.keys, np.arange(known, dtype=np.int32))
        self.places.add(keys[order], np.arange(known, known + len(order), dtype=np.int32))
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.keys = np.concatenate([self.keys, keys[order]])
        self.count = np.concatenate([self.count, counts])
        self.met = np.concatenate([self.met, np.zeros(len(counts), np.int64)])
        self.ids = np.concatenate([self.ids, ids, more])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        whole = b" ".join([*texts, b""])
        buffer = np.frombuffer(whole, np.uint8)
        inside = ~_BLANK[buffer]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        keys = RangeHash(buffer).of(start, end)
        keys += keys == 0
        codes = self.places.find(keys)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            if len(fresh) > REMEMBERED - KEPT:  # one long text of new words: no table would be of use
                ids, counts = self._encoded([t.decode() for t in texts])
                return ids, counts.astype(np.int64)
            if len(self.keys) + len(fresh) > REMEMBERED and len(self.keys) > KEPT:
                self._trim()
                return self.encode(texts)
            at = missing[first]
            self._learn(fresh, [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            codes[missing] = self.places.find(keys[missing])
        self.met += np.bincount(codes, minlength=len(self.met))
        counts = self.count[codes]
        ends = np.cumsum(counts, dtype=np.int64)
        place = np.repeat(self.start[codes] - (ends - counts).astype(np.int32), counts)
        place += np.arange(len(place), dtype=np.int32)
        edges = np.concatenate([[0], ends])
        borders = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        return self.ids[place], np.diff(edges[borders])


_CODECS: dict[str, WordCodec] = {}


def codec_of(path: str) -> WordCodec:
    """This worker's codec: a task goes on with the words that earlier tasks met."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]
