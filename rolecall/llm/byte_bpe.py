"""Byte-level BPE in both directions, as recursive queries over the token positions of a partition.

Every task holds the merge table and the vocabulary in an in-process DuckDB of its
own memory. Encoding: each byte of the words not met before is a row (unit, place,
token). A recursive query joins neighbouring rows with the merge table, contracts
each unit's leftmost pair of least rank, and goes on with the units that had one,
until none is left. Decoding: the ids are rows of (text, place, id), joined with the
vocabulary and aggregated in the order of their places.

Texts stay in their partition: nothing is shuffled, and a rerun task gives the same
rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.chunks import CodedLists, KeyedLists, chunk_codes
from rolecall.llm.common import blocks, give_back, small_batches, text_values

#: Words a worker remembers besides its chunks.
WORDS = 200_000
#: Text of one look-up, bytes of new words in one recursive query and ids in one decoding; a longer text or word has its own.
TEXT_BYTES, WORD_BYTES, IDS = 2_000_000, 400_000, 400_000
#: Units of more bytes contract all places of a pair at once where that comes to the same.
LONG = 64
#: DuckDB's share of a worker's memory. A row of a query takes about 100 bytes.
MEMORY = "400MB"

_PAIRS = """x AS MATERIALIZED (
    SELECT unit, place, token, before, alone, rank + place AS k FROM (
      SELECT unit, place, token, lag(place, 1, -1) OVER o AS before, CASE WHEN lead(unit) OVER o = unit THEN token::BIGINT * 4294967296 + lead(token) OVER o END AS pair
      FROM s WHERE NOT done WINDOW o AS (ORDER BY place)) y
    LEFT JOIN merges ON merges.pair = y.pair),
  best AS (SELECT unit, min(k) AS k FROM x WHERE k IS NOT NULL GROUP BY unit)"""

#: Each unit's leftmost pair of least rank becomes one token. A pair's key is its rank and, below 2 ** 32, its place.
ENCODE = f"""
WITH RECURSIVE s(done, unit, place, token) AS (
  SELECT false, unit, place, token FROM bytes
  UNION ALL
  (WITH {_PAIRS}
  SELECT best.unit IS NULL, x.unit, x.place, CASE WHEN x.k = best.k THEN (best.k >> 32)::INTEGER ELSE x.token END
  FROM x LEFT JOIN best ON best.unit = x.unit WHERE best.unit IS NULL OR x.before <> best.k & 4294967295)
)
SELECT place, token FROM s WHERE done ORDER BY place
"""

#: The same for long units: all places of that pair from the left on, unless its token may be merged on before them.
ENCODE_LONG = f"""
WITH RECURSIVE s(done, unit, place, token) AS (
  SELECT false, unit, place, token FROM bytes
  UNION ALL
  (WITH {_PAIRS},
  hits AS (
    SELECT best.unit IS NULL AS done, x.unit, x.place, x.token, best.k >> 32 AS rank, row_number() OVER (ORDER BY x.place) AS n,
      coalesce(x.k = best.k OR (x.k >> 32 = best.k >> 32 AND NOT x.alone), false) AS hit
    FROM x LEFT JOIN best ON best.unit = x.unit),
  runs AS (SELECT *, (n - max(CASE WHEN hit THEN 0 ELSE n END) OVER (ORDER BY place)) % 2 = 1 AS taken FROM hits)
  SELECT done, unit, place, CASE WHEN taken THEN rank::INTEGER ELSE token END
  FROM (SELECT *, lag(taken, 1, false) OVER (ORDER BY place) AS gone FROM runs) WHERE NOT gone)
)
SELECT place, token FROM s WHERE done ORDER BY place
"""

DECODE = """
SELECT text, list(vocabulary.bytes ORDER BY place) AS bytes, count(*) - count(vocabulary.id) AS unknown
FROM ids LEFT JOIN vocabulary ON vocabulary.id = ids.id GROUP BY text ORDER BY text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """One worker's vocabulary, its database, and the words it has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.inside = np.zeros((256, 256), bool)  # neighbours within some token; no merge ever joins others
        pairs, merged, early = [], [], set()
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                self.inside[token[i - 1], token[i]] = True
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
                    early.update(x for x in (a, b) if x > rank)  # may be merged on before equal pairs are
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "allocator_flush_threshold": "16MB"})
        merges = [pa.array(pairs, pa.int64()), pa.array([m << 32 for m in merged], pa.int64()), pa.array([m in early for m in merged])]
        self._query("CREATE TABLE merges AS SELECT * FROM given", given=pa.table(merges, ["pair", "rank", "alone"]))
        self._query("CREATE TABLE vocabulary AS SELECT * FROM given", given=pa.table([pa.array(self.ranks.values(), pa.int32()), pa.array(self.ranks, pa.binary())], ["id", "bytes"]))
        self.codes: dict[str, int] = {}
        self.ids, self.chunks = CodedLists(), KeyedLists()

    def _query(self, sql: str, **tables: pa.Table):
        for name, rows in tables.items():
            self.db.register(name, rows)
        found = self.db.sql(sql)
        found = found and found.to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return found

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words after all merges, tokens per word); no word is empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        edges = np.cumsum([0, *map(len, words)])
        begins = np.ones(len(data), bool)
        begins[1:] = ~self.inside[data[:-1], data[1:]]
        begins[edges[:-1]] = True
        unit = np.cumsum(begins, dtype=np.int32)
        rows = [unit, np.arange(len(data), dtype=np.int32), self.single[data]]
        long = (np.bincount(unit) > LONG)[unit]
        places, tokens = [], []
        for sql, of in ((ENCODE, ~long), (ENCODE_LONG, long)):
            if of.any():
                found = self._query(sql, bytes=pa.table([pa.array(r[of]) for r in rows], ["unit", "place", "token"]))
                places.append(found["place"].to_numpy())
                tokens.append(found["token"].to_numpy())
        place, token = np.concatenate(places), np.concatenate(tokens)
        order = np.argsort(place, kind="stable")
        return token[order], np.diff(np.searchsorted(place[order], edges))

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per chunk): words that are tokens as they are, all others by the recursive query."""
        split = [self.find(c.decode("utf-8", "replace")) for c in chunks]
        words = list(chain.from_iterable(split))
        different = set(words)
        if len(self.codes) + len(different) > WORDS:
            self.codes, self.ids = {}, CodedLists()
        rest = []
        for word in different:
            if word not in self.codes:
                data = word.encode()
                rank = self.ranks.get(data)
                if rank is None:
                    rest.append((word, data))
                else:
                    self.codes[word] = self.ids.add_one(rank)
        for lo, hi in blocks([data for _, data in rest], WORD_BYTES):
            first = self.ids.add(*self.contract([data for _, data in rest[lo:hi]]))
            self.codes.update(zip((word for word, _ in rest[lo:hi]), range(first, first + hi - lo), strict=True))
        ids, counts = self.ids.of(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
        owner = np.repeat(np.arange(len(chunks)), [len(words) for words in split])
        return ids, np.bincount(owner, counts, len(chunks)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text)."""
        codes, chunks = chunk_codes(self.chunks, texts, self._learn)
        ids, counts = self.chunks.of(codes)
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(edges[np.cumsum([0, *chunks])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Every text's bytes; null where an id is not in the vocabulary."""
        if not len(ids):
            return pa.array([b""] * len(counts), pa.binary())
        rows = [np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.arange(len(ids), dtype=np.int32), ids.astype(np.int32)]
        found = self._query(DECODE, ids=pa.table([pa.array(r) for r in rows], ["text", "place", "id"])).combine_chunks()
        out: list = [b""] * len(counts)
        texts, lists = found["text"].to_pylist(), found["bytes"].combine_chunks()
        if len(lists):
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            tokens = lists.values.cast(pa.large_binary())
            edges = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][lists.offsets.to_numpy()]
            data = memoryview(tokens.buffers()[2] or b"")
            for text, unknown, a, b in zip(texts, found["unknown"].to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[text] = None if unknown else bytes(data[a:b])  # a list's tokens stand end to end
        return pa.array(out, pa.binary())

_CODECS: dict[tuple[str, str], ByteBpe] = {}


def bpe_of(path: str, pattern: str) -> ByteBpe:
    """This worker's vocabulary: a task goes on with the words that earlier tasks met."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            texts = text_values(batch.column(1))
            for lo, hi in blocks(texts, TEXT_BYTES):
                ids, counts = bpe.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "ids"])
        give_back()

    return run


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            ids = column.flatten().to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + IDS, "right")) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column.slice(lo, hi - lo), bpe.decode(ids[edges[lo] : edges[hi]], sizes[lo:hi])], ["doc_id", "ids", "decoded"])
                lo = hi
        give_back()

    return run


def encode_bytes(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text's token ids, without special tokens.

    Reads doc_id and text; other columns are ignored. Each match of `pattern` is
    encoded on its own: a match that is a token is that token, any other starts as
    its bytes. The pattern must end a match before every space that stands behind a
    visible character, as the public patterns do. Null and empty texts have no ids;
    rows without doc_id and repeated rows are encoded each; special tokens' strings
    are plain text. A text of any length is encoded whole; a single match takes about
    100 bytes of memory for each of its bytes between two that no token joins.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_encoded(ranks_path, pattern), "doc_id long, ids array<int>")


def decode_bytes(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that each row's ids stand for.

    Null and empty lists decode to no bytes; a list with an id outside the vocabulary
    decodes to null.
    """
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(ranks_path, pattern), "doc_id long, ids array<int>, decoded binary")
