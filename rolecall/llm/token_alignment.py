"""Two tokenizers' tokens laid side by side: groups of equal bytes, and which ids end together how often.

A byte-level BPE (A) and a piece BPE with byte fallback (B) encode the same bytes.
Offsets where both end a token cut them into groups, and the tokens that end there
are linked. Most groups are one token on each side with the same bytes: for these an
array gives B's id for each id of A, and their links are counted in a vector as long
as A's vocabulary. Only the links of other groups travel as pairs of ids.

Counts over the corpus are exact. What tasks share is bounded by the vocabularies and
by HEAD, the number of frequent pairs that are broadcast; all other pairs meet their
counts in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.chunks import KeyedLists, chunk_codes
from rolecall.llm.common import blocks, give_back, ragged, small_batches, staged, text_values

#: Pairs whose counts are broadcast, and pairs that a task counts before it sends its counts on.
HEAD, HELD = 1_000_000, 1_000_000
#: Bytes of chunks that are encoded as one text.
TOGETHER = 20_000
#: Counts of A's vocabulary that travel in one row.
SLICE = 1_024

_SPACE = "▁"  # a space in B's pieces
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
# A chunk that ends in a blank, or holds B's mark of a space, is encoded on its own.
_ALONE = re.compile(rf"\s\Z|{_SPACE}")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: itself where it is printable, else counted on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """The bytes of every id, end to end, and their places."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.size[ids])]


class Aligner:
    """Both tokenizers, and what a worker knows of the chunks that it has met."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_level_alphabet()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        marks = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        self.of_a = Vocabulary([bytes(byte[c] for c in e) for e in entries])
        self.of_b = Vocabulary([bytes([int(m[1], 16)]) if m else p.replace(_SPACE, " ").encode() for m, p in zip(marks, pieces, strict=True)])
        self.blank = self.b.piece_to_id(_SPACE)
        same = {}
        for i in sorted(range(len(pieces)), key=lambda i: marks[i] is None):  # a piece goes before the byte it spells
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                same[self.of_b.tokens[i]] = i
        #: B's id with the same bytes, -1 where it has none.
        self.same = np.array([same.get(t, -1) for t in self.of_a.tokens], np.int64)
        self.digits = [[f"{i}{end}" for i in range(len(v.tokens))] for v, ends in ((self.of_a, ",|"), (self.of_b, ",;")) for end in ends]
        self.links = KeyedLists(np.int64)
        self.sizes, self.groups = np.zeros((0, 4), np.int64), []

    def _encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both id lists of texts that begin with a space; B puts it there itself."""
        ours = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [(a, b if len(t) > 1 else [self.blank]) for t, a, b in zip(texts, ours, theirs, strict=True)]

    def _aligned(self, data: bytes, a: np.ndarray, b: np.ndarray, edges: np.ndarray):
        """(links, links per chunk, sizes, groups) of chunks that end at `edges` of data; None unless both spell it and end tokens there."""
        if self.of_a.spelled(a).tobytes() != data or self.of_b.spelled(b).tobytes() != data:
            return None
        end_a, end_b = np.cumsum(self.of_a.size[a]), np.cumsum(self.of_b.size[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(edges, cuts, assume_unique=True).all():
            return None
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = end_a == cuts[group_a], end_b == cuts[group_b]
        one = (np.bincount(group_a) == 1) & (np.bincount(group_b) == 1)
        x, y = a[last_a].astype(np.int64), b[last_b].astype(np.int64)
        links = np.where(one & (self.same[x] == y), x, (x + 1) << 32 | y)
        per_chunk = np.diff(np.searchsorted(cuts, edges, "right"), prepend=0)
        n_a, n_b = (np.diff(np.searchsorted(e, edges, "right"), prepend=0) for e in (end_a, end_b))
        sizes = np.stack([n_a, n_b, per_chunk, np.ones(len(edges), np.int64)], axis=1)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        comma_a, bar, comma_b, semicolon = self.digits
        words = [(bar if z else comma_a)[i] for i, z in zip(a.tolist(), last_a.tolist(), strict=True)] + [(semicolon if z else comma_b)[i] for i, z in zip(b.tolist(), last_b.tolist(), strict=True)]
        words = [words[i] for i in order.tolist()]
        ends = np.cumsum(n_a + n_b).tolist()
        return links, per_chunk, sizes, ["".join(words[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(chunks)
        texts = [c.decode("utf-8", "replace") for c in chunks]
        together = [i for i, t in enumerate(texts) if not _ALONE.search(t)]
        runs = [together[lo:hi] for lo, hi in blocks([chunks[i] for i in together], TOGETHER)]
        for at in range(0, len(runs), 16):  # an encoding takes much more room than its ids
            for run, (a, b) in zip(runs[at : at + 16], self._encode(["".join([texts[i] for i in run]) for run in runs[at : at + 16]]), strict=True):
                data = b"".join([chunks[i] for i in run])
                made = self._aligned(data, np.array(a, np.int64), np.array(b, np.int64), np.cumsum([len(chunks[i]) for i in run]))
                if made:
                    links, counts, sizes, groups = made
                    parts = np.split(links, np.cumsum(counts)[:-1])
                    for i, *part in zip(run, parts, sizes, groups, strict=True):
                        found[i] = part
        rest = [i for i, part in enumerate(found) if part is None]
        for at in range(0, len(rest), 1_000):
            some = rest[at : at + 1_000]
            for i, (a, b) in zip(some, self._encode([texts[i] for i in some]), strict=True):
                made = self._aligned(chunks[i], np.array(a, np.int64), np.array(b, np.int64), np.array([len(chunks[i])]))
                found[i] = [made[0], made[2][0], made[3][0]] if made else [np.zeros(0, np.int64), np.zeros(4, np.int64), ""]
        self.sizes = np.concatenate([self.sizes, np.stack([f[1] for f in found])])
        self.groups += [f[2] for f in found]
        return np.concatenate([f[0] for f in found]), np.array([len(f[0]) for f in found], np.int64)

    def _forget(self, kept: np.ndarray) -> None:
        self.sizes, self.groups = self.sizes[kept], [self.groups[i] for i in kept.tolist()]

    def align(self, texts: list[bytes]):
        """(sizes, groups, link, text of the link, its times): sizes are tokens of A and B, and groups, zero where a text has no tokens."""
        codes, chunks = chunk_codes(self.links, [b" " + t if t else t for t in texts], self._learn, self._forget)
        text = np.repeat(np.arange(len(texts)), chunks)
        bad = np.bincount(text, self.sizes[codes, 3] == 0, len(texts)) > 0
        sizes = np.stack([np.bincount(text, self.sizes[codes, k], len(texts)) for k in range(3)], axis=1).astype(np.int64)
        sizes[bad] = 0
        of, ends = codes.tolist(), np.cumsum(chunks).tolist()
        groups = ["" if no else "".join(map(self.groups.__getitem__, of[i:j]))[:-1] for no, i, j in zip(bad.tolist(), [0, *ends[:-1]], ends, strict=True)]
        links, counts = self.links.of(codes)
        owner = np.repeat(text, counts)
        links, owner = links[~bad[owner]], owner[~bad[owner]]
        different, place = np.unique(links, return_inverse=True)
        both, times = np.unique(owner * max(1, len(different)) + place, return_counts=True)
        owner, place = np.divmod(both, max(1, len(different)))
        return sizes, groups, different[place], owner, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """This worker's tokenizers: a task goes on with the chunks that earlier tasks met."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>"


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = text_values(batch.column(1))
            for lo, hi in blocks(texts):
                n = hi - lo
                sizes, groups, links, owner, times = aligner.align(texts[lo:hi])
                edges = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), batch.column(0).slice(lo, n), *map(pa.array, sizes.T), pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(edges, pa.array(links)), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
                ], names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times"])
                row += n
        give_back()

    return run


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its groups as text, and its links with their times.

    Reads doc_id and text; other columns are ignored. A encodes a space and the text,
    B the text, which it puts a space before. `groups` reads `a1,a2|b1;a3|b2,b3`. A
    link is A's id where B's id with the same bytes stands alone beside it, and
    (A's id + 1) * 2 ** 32 + B's id for any other pair. Null and empty texts, and texts
    that either tokenizer spells otherwise, have no tokens. Repeated rows and rows
    without doc_id are aligned each; special tokens' strings are plain text; texts of
    any length are aligned whole.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_align(a_path, b_path), _ALIGNED)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(link, its row of the batch, its times) of columns links and times."""
    links, times = batch.column(batch.schema.get_field_index("links")), batch.column(batch.schema.get_field_index("times"))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(links.offsets.to_numpy()))
    return links.flatten().to_numpy(zero_copy_only=False), owner, times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _count(size: int):
    """Same-byte links in a vector as long as A's vocabulary, in slices; all others as pairs, many documents' together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, keys, sums = np.zeros(-(-size // SLICE) * SLICE, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def pairs():
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(sums)], names=["slice", "counts", "pair", "n"])

        for batch in batches:
            links, _, times = _links(batch)
            plain = links >> 32 == 0
            vector += np.bincount(links[plain], times[plain], len(vector)).astype(np.int64)
            keys, back = np.unique(np.concatenate([keys, links[~plain]]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, times[~plain]]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield pairs()
                keys, sums = keys[:0], sums[:0]
        yield pairs()
        parts = vector.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64())], names=["slice", "counts", "pair", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(data, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])


def link_counts(aligned: DataFrame, vocabulary: int) -> tuple[np.ndarray, DataFrame]:
    """How often each link stands in the corpus: the vector of same-byte links, and (pair, n) of all others."""
    counted = staged(aligned.select("links", "times").mapInArrow(_count(vocabulary), "slice int, counts binary, pair long, n long"), "counted")
    slices = counted.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_added, "slice int, counts binary").collect()
    vector = np.zeros(vocabulary, np.int64)
    for i, data in slices:
        part = np.frombuffer(data, np.int64)[: max(0, vocabulary - i * SLICE)]
        vector[i * SLICE : i * SLICE + len(part)] = part
    pairs = counted.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
    return vector, staged(pairs, "pairs")


_RATED = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "pair", "n"]
_RATED_TYPES = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, pair long, n long"


def _rate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, vector_best, head, head_n, head_best = shared.value
        for batch in batches:
            links, owner, times = _links(batch)
            rows = batch.num_rows
            plain = links >> 32 == 0
            n, best = np.zeros(len(links), np.int64), np.zeros(len(links), bool)
            n[plain], best[plain] = vector[links[plain]], vector_best[links[plain]]
            other = np.flatnonzero(~plain)
            place = np.minimum(np.searchsorted(head, links[other]), max(0, len(head) - 1))
            known = head[place] == links[other] if len(head) else np.zeros(len(other), bool)
            n[other[known]], best[other[known]] = head_n[place[known]], head_best[place[known]]
            total = np.zeros(rows, np.int64)
            np.add.at(total, owner, n * times)
            best_total = np.bincount(owner, best * times, rows).astype(np.int64)
            all_links = np.bincount(owner, times, rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(all_links), pa.array(best_total), pa.array(total), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=_RATED)
            rare = other[~known]
            m = len(rare)
            blank = [pa.nulls(m, pa.int64()) for _ in range(4)] + [pa.nulls(m, pa.string())] + [pa.nulls(m, pa.int64()) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[rare])), *blank, pa.array(links[rare]), pa.array(times[rare])], names=_RATED)

    return run


def rate_links(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document its tokens, groups and links, and how usual its links are in the whole corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose corpus-wide count
    is the highest that their B id has, ties included), count_sum (these counts, over
    the links) and groups_sha256 ('' without tokens). Cases as in `align_documents`.
    """
    spark = documents.sparkSession
    aligner = aligner_of(a_path, b_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    aligned = staged(align_documents(documents, a_path, b_path).withColumn("groups", digest), "aligned")
    vector, pairs = link_counts(aligned, len(aligner.same))

    highest = np.zeros(len(aligner.of_b.tokens), np.int64)
    paired = aligner.same >= 0
    np.maximum.at(highest, aligner.same[paired], vector[paired])
    of_b = F.expr("pair & 4294967295")
    tops = pairs.groupBy(of_b.alias("b")).agg(F.max("n").alias("n")).toPandas()  # a row for each id of B at most
    np.maximum.at(highest, tops["b"].to_numpy(np.int64), tops["n"].to_numpy(np.int64))

    # Counts by eighths of their powers of two: a few hundred rows tell from which count on pairs are few enough.
    eighth = F.floor(F.log2("n") * 8)
    classes = pairs.groupBy(eighth.alias("e")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("e", ascending=False)
    few = classes["e"][classes["n"].cumsum() <= HEAD]
    least = int(few.min()) if len(few) else 1 << 20
    head = pairs.filter(eighth >= least).toPandas().sort_values("pair")
    keys, counts = head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    vector_best = paired & (vector == highest[aligner.same])
    shared = spark.sparkContext.broadcast((vector, vector_best, keys, counts, counts == highest[keys & 0xFFFFFFFF]))

    parts = staged(aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times").mapInArrow(_rate(shared), _RATED_TYPES), "rated")
    top_rows = spark.createDataFrame([(i, n) for i, n in enumerate(highest.tolist()) if n], "b long, top long")
    tail = pairs.filter(eighth < least).withColumn("b", of_b).join(F.broadcast(top_rows), "b").select("pair", F.col("n").alias("of_pair"), (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    rare = parts.filter("pair IS NOT NULL").select("row", "pair", "n").join(tail, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("is_best")).alias("more_best"), F.sum(F.col("n") * F.col("of_pair")).alias("more_sum"))
    rows = parts.filter("pair IS NULL").drop("pair", "n").join(rare, "row", "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def token_pairs(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n): every pair of ids that is linked in the corpus, and how often."""
    aligner = aligner_of(a_path, b_path)
    aligned = staged(align_documents(documents, a_path, b_path).drop("groups"), "aligned")
    vector, pairs = link_counts(aligned, len(aligner.same))
    plain = documents.sparkSession.createDataFrame([(a, int(aligner.same[a]), int(vector[a])) for a in np.flatnonzero(vector).tolist()], "a_id long, b_id long, n long")
    return plain.unionByName(pairs.select(F.expr("(pair >> 32) - 1").alias("a_id"), F.expr("pair & 4294967295").alias("b_id"), "n"))
