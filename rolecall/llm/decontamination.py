"""Benchmark decontamination: exact candidates by counted words, then subsequences.

Texts are cut into passages of two steps of STEP words; a passage's surroundings
reach as far as an item that begins before it or ends behind it. An item is leaked
where the longest common subsequence of its telling words (words that are not common
in the corpus) and the surroundings is long enough, with or without the item's answer
(its last sentence; one without telling words is held whole against all words). A subsequence holds no more words than the surroundings have of
the item's, so words are joined with the items' words and counted by step, and every
passage whose surroundings count enough is a candidate. The count is never less than
the subsequence: no pair that the test accepts is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import blocks, ragged, small_batches, staged, text_values
from rolecall.llm.hashing import narrow_hashes

#: Words of a step; a passage is two steps.
STEP = 12
#: Hashed words.
BITS = 14
FEATURES = 1 << BITS
#: An item is leaked if the common subsequence holds COPIED of its words, or PARAPHRASED of them and ANSWERED of its answer's.
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.55, 0.8
#: A word in more than this share of the corpus's steps is common and proves nothing; an item needs TELLING other words, else all count.
COMMON, TELLING = 0.02, 3
#: Benchmark items held against the corpus in one scan, and candidates verified at once in a task.
ITEM_BLOCK, TOGETHER = 2_000, 20_000
#: Parts in which the frequencies are summed.
PARTS = 16
#: Counts by item and step that a task holds at once, and items whose windows are counted alike.
CELLS, ALIKE = 4_000_000, 32

_U = np.uint64
_GAP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text): runs of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    whole = b" ".join([*texts, b""]).translate(_GAP)
    buffer = np.frombuffer(whole, np.uint8)
    inside = buffer != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buffer) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return narrow_hashes(buffer, start, end), np.diff(np.searchsorted(start, borders))


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(32 - BITS)).astype(np.int64)


def _steps(features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every step, steps per text): rows of STEP features, FEATURES where a text's last step is short."""
    number = -(-counts // STEP)
    out = np.full(int(number.sum()) * STEP, FEATURES, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(features)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[(np.cumsum(number) - number)[text] * STEP + place] = features
    return out.reshape(-1, STEP), number


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's numbers of steps that hold a feature, in PARTS rows."""
    df, steps = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        texts = text_values(batch.column(0))
        for lo, hi in blocks(texts):
            words, counts = words_of(texts[lo:hi])
            rows, _ = _steps(_features(words), counts)
            if not len(rows):
                continue
            steps += len(rows)
            held = np.sort(rows.astype(np.uint16), axis=1)
            fresh = np.ones(held.shape, bool)
            fresh[:, 1:] = held[:, 1:] != held[:, :-1]
            df += np.bincount(held[fresh], minlength=FEATURES + 1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([p.tobytes() for p in np.split(df[:FEATURES], PARTS)], pa.binary()), pa.array([steps] * PARTS, pa.int64())],
        names=["part", "sums", "steps"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    steps: dict[int, int] = {}
    for batch in batches:
        for part, data, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(data.as_buffer(), np.int64)
            steps[part] = steps.get(part, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()), pa.array(list(steps.values()), pa.int64())], names=["part", "sums", "steps"])


def common_features(texts: DataFrame) -> np.ndarray:
    """Which features are in more than COMMON of the corpus's steps."""
    parts = texts.mapInArrow(_fit, "part int, sums binary, steps long").repartition(PARTS, "part").mapInArrow(_added, "part int, sums binary, steps long")
    parts = parts.toPandas().sort_values("part")
    if not len(parts) or not parts["steps"].iloc[0]:
        return np.zeros(FEATURES, bool)
    return np.concatenate([np.frombuffer(s, np.int64) for s in parts["sums"]]) > COMMON * parts["steps"].iloc[0]


def common_subsequence(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Words of the longest common subsequence of `item` and each row of `texts`, in bit-parallel form, 63 words of the item at a limb."""
    unique, code = np.unique(item, return_inverse=True)
    limbs = -(-len(item) // 63)
    masks = np.zeros((limbs, len(unique) + 1), _U)
    for i, c in enumerate(code):
        masks[i // 63, c] |= _U(1) << _U(i % 63)
    place = np.minimum(np.searchsorted(unique, texts), len(unique) - 1)
    place = np.where(unique[place] == texts, place, len(unique))
    low = _U((1 << 63) - 1)
    rows = [np.full(len(texts), low, _U) for _ in range(limbs)]
    for column in place.T:
        carry = np.zeros(len(texts), _U)
        for i in range(limbs):
            both = rows[i] & masks[i, column]
            total = rows[i] + both + carry
            carry = total >> _U(63)
            rows[i] = (total & low) | (rows[i] & ~both)
    return sum(np.bitwise_count(~r & low).astype(np.int64) for r in rows)


class Items:
    """Some benchmark items: telling words, those of the answers, and the index from words to items."""

    def __init__(self, ids: list, texts: list[str], common: np.ndarray):
        words, self.sizes = words_of([t.encode() for t in texts])
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.array(ids, np.int64)
        self.words = [words[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found, sizes = words_of([(re.split(r"(?<=[.!?])\s+", t.strip()) or [""])[-1].encode() for t in texts])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.answers = [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.telling = np.array([(~common[_features(w)]).sum() >= TELLING for w in self.words], bool)
        self.plain = ~self.telling  # items whose answers are held whole against all words
        for i in np.flatnonzero(self.telling):
            self.words[i], answer = (x[~common[_features(x)]] for x in (self.words[i], self.answers[i]))
            self.plain[i] = not len(answer)
            self.answers[i] = self.answers[i] if self.plain[i] else answer
        # The fewest words of an item that the test may accept.
        self.least = np.array([np.ceil(min(PARAPHRASED, COPIED) * len(w) - 1e-9) for w in self.words], np.int64)
        # Items by size: neighbours in this order have windows of about the same length.
        self.order = np.argsort(self.sizes, kind="stable")
        pairs = [np.unique(self.words[i]) for i in self.order]
        word, rank = np.concatenate([*pairs, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        by = np.argsort(word, kind="stable")
        self.ranks = rank[by]
        self.vocabulary, self.first, self.number = np.unique(word[by], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary >> np.uint32(12)] = True

    def candidates(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, texts, first words in their texts) of the passages whose surroundings hold enough of the item's words."""
        if not len(self.vocabulary):
            return
        number, heads = -(-counts // STEP), np.cumsum(counts) - counts
        head, steps = np.cumsum(number) - number, int(number.sum())
        owner = np.repeat(np.arange(len(counts)), number)
        opens = np.ones(steps, bool)  # every two neighbouring steps are a passage, or a lone one
        opens[(head + number - 1)[number > 1]] = False
        hit = np.flatnonzero(self.maybe[words >> np.uint32(12)])
        slot = np.minimum(np.searchsorted(self.vocabulary, words[hit]), len(self.vocabulary) - 1)
        same = self.vocabulary[slot] == words[hit]
        hit, slot = hit[same], slot[same]
        text = np.repeat(np.arange(len(counts)), counts)[hit]
        step = head[text] + (hit - heads[text]) // STEP
        rank, step = self.ranks[ragged(self.first[slot], self.number[slot])], np.repeat(step, self.number[slot])
        alike = max(1, min(ALIKE, CELLS // max(1, steps)))
        for a in range(0, len(self.order), alike):
            group = self.order[a : a + alike]
            reach = int(self.sizes[group].max()) + STEP
            before, behind = -(-reach // STEP), -(-(reach + 2 * STEP) // STEP)
            width = steps + before + behind
            mine = (rank >= a) & (rank < a + alike)
            held = np.bincount((rank[mine] - a) * width + step[mine] + before, minlength=len(group) * width)
            sums = np.zeros((len(group), width + 1), np.int32)
            np.cumsum(held.reshape(len(group), width), axis=1, out=sums[:, 1:])
            enough = sums[:, before + behind : before + behind + steps] - sums[:, :steps] >= self.least[group][:, None]
            for i in np.flatnonzero(enough.any(axis=1)).tolist():
                at = np.flatnonzero(enough[i] & opens)
                if len(at):
                    yield int(group[i]), owner[at], (at - head[owner[at]]) * STEP

    def verified(self, item: int, around: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaked, share of the item's words, share of its answer's) of some candidates' surroundings; `whole` holds their untouched words if the item is plain."""
        share = common_subsequence(self.words[item], around) / len(self.words[item])
        maybe = share >= min(PARAPHRASED, COPIED)
        answer = np.zeros(len(around))
        if maybe.any() and len(self.answers[item]):
            answer[maybe] = common_subsequence(self.answers[item], (whole if self.plain[item] else around)[maybe]) / len(self.answers[item])
        return (share >= COPIED) | (maybe & (answer >= ANSWERED)), share, answer


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, items = shared.value
        waiting: dict[int, list[tuple]] = {}
        number = 0

        def settle():
            rows = []
            for item, parts in waiting.items():
                around, whole, doc, text = (np.concatenate(x) for x in zip(*parts, strict=True))
                leak, share, answer = items.verified(item, around, whole)
                rows += [(d, t, int(items.ids[item]), s, w) for d, t, s, w in zip(doc[leak].tolist(), text[leak].tolist(), share[leak].tolist(), answer[leak].tolist(), strict=True)]
            waiting.clear()
            names = ["doc_id", "text_hash", "item_id", "lcs_share", "answer_share"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            doc, *rest = zip(*rows, strict=True) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc, *rest), kinds, strict=True)], names=names)

        for batch in batches:
            texts = text_values(batch.column(2))
            doc = np.array(batch.column(0).to_pylist(), object)
            mark = np.asarray(batch.column(1))
            for lo, hi in blocks(texts):
                words, counts = words_of(texts[lo:hi])
                if not len(words):
                    continue
                heads = np.cumsum(counts) - counts
                telling = np.where(common[_features(words)], np.uint32(0), words)
                for j, owner, start in items.candidates(words, counts):
                    reach = int(items.sizes[j]) + STEP  # the item may begin before the passage or end behind it
                    seen = telling if items.telling[j] else words
                    for a in range(0, len(start), TOGETHER):
                        own = owner[a : a + TOGETHER]
                        place = (start[a : a + TOGETHER] - reach)[:, None] + np.arange(2 * reach + 2 * STEP)
                        inside = (place >= 0) & (place < counts[own][:, None])
                        at = np.where(inside, place + heads[own][:, None], 0)
                        around = np.where(inside, seen[at], np.uint32(0))
                        whole = np.where(inside, words[at], np.uint32(0)) if items.plain[j] else around
                        waiting.setdefault(j, []).append((around, whole, doc[lo + own], mark[lo + own]))
                        number += len(own)
                        if number > TOGETHER:
                            yield settle()
                            number = 0
        yield settle()

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, lcs_share, answer_share: benchmark items that whole texts hold.

    Reads doc_id and text of `documents`, item_id and text of `benchmark` (other
    columns are ignored). text_hash is xxhash64 of the text and tells rows apart that
    share a doc_id or have none. Null texts, and texts or items without words, hold
    and leak nothing; items without item_id are skipped; equal items leak each.
    Equal rows of a table give one row.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    number = items.count()
    common = common_features(docs.select("text")) if number else None
    blocks_of = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-number // ITEM_BLOCK)))))
    found = []
    for block in range(-(-number // ITEM_BLOCK)):
        rows = blocks_of.filter(F.col("_block") == block).select("item_id", "text").toPandas().sort_values(["item_id", "text"])
        kept = [n > 0 for n in Items(rows["item_id"].tolist(), rows["text"].tolist(), common).sizes] if len(rows) else []
        rows = rows[kept] if any(kept) else rows[:0]
        if len(rows):
            shared = spark.sparkContext.broadcast((common, Items(rows["item_id"].tolist(), rows["text"].tolist(), common)))
            found.append(docs.mapInArrow(_search(shared), "doc_id long, text_hash long, item_id long, lcs_share double, answer_share double"))
    if not found:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, lcs_share double, answer_share double")
    both = reduce(DataFrame.union, found)
    return staged(both, "leaks").groupBy("doc_id", "text_hash", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))
