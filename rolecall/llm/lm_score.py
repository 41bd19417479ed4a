"""Prediction by partial matching: code lengths under a pretrained byte-context trie.

Two models are counted over all training rows: words (with an end mark) for the
base score, and a trie of byte contexts of ORDER bytes for the score. A byte is
predicted by its longest seen context; unseen bytes escape to the next shorter
context with method C's estimate (different symbols over symbols plus different
symbols), and symbols of the longer contexts are excluded there. Below the empty
context all symbols left are equally likely.

Neither the words nor the trie's nodes (a context with a symbol, a gram) are
bounded by anything but the corpus. At most HEAD of the most frequent words and
HEAD_GRAMS of the most frequent grams are broadcast, the grams with their final
value; all others, and grams that training did not see, meet their counts in joins
over every level of the trie.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import blocks, small_batches, staged, text_values

#: Bytes of context: a gram of 6 symbols is a number below 257 ** 6; more than 6 bytes do not fit a long.
ORDER = 5
#: Words whose counts are broadcast.
HEAD = 200_000
#: Words a task counts before it sends its counts on.
HELD = 400_000
#: Grams whose values are broadcast (16 bytes each), and grams a task counts before it sends its counts on.
HEAD_GRAMS, HELD_GRAMS = 1_000_000, 2_000_000
#: 256 byte values and the mark of a text's end, which is also its beginning's context.
SYMBOLS, END = 257, 256

_COUNTS = "kind int, word binary, node long, n long"


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, first symbol of each text): an end mark closes every text."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    symbol = np.full(int(sizes.sum()), END, np.int32)
    heads = np.cumsum(sizes) - sizes
    inside = np.ones(len(symbol), bool)
    inside[heads + sizes - 1] = False
    symbol[inside] = np.frombuffer(b"".join(texts), np.uint8)
    context = np.zeros(len(symbol), np.int64)
    for back in range(ORDER, 0, -1):
        earlier = np.full(len(symbol), END, np.int32)
        earlier[back:] = symbol[:-back]
        for i in range(back):  # symbols of the text before are no context
            at = heads + i
            earlier[at[at < np.append(heads[1:], len(symbol))]] = END
        context = context * SYMBOLS + earlier
    return context, symbol, heads


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same grams added up."""
    nodes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return nodes, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(nodes)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[bytes] = Counter()
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, fresh, waiting = empty, [], 0
    ends = 0

    def rows(kind, words, nodes, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), words, nodes, pa.array(n, pa.int64())], names=["kind", "word", "node", "n"])

    def word_rows():
        return rows(0, pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), list(words.values()))

    def gram_rows():
        return rows(1, pa.nulls(len(grams[0]), pa.binary()), pa.array(grams[0]), grams[1])

    for batch in batches:
        texts = text_values(batch.column(0))
        ends += len(texts)
        for lo, hi in blocks(texts):
            words.update(chain.from_iterable(t.lower().split() for t in texts[lo:hi]))
            context, symbol, _ = _symbols(texts[lo:hi])
            fresh.append(np.unique(context * SYMBOLS + symbol, return_counts=True))
            waiting += len(fresh[-1][0])
            if waiting > max(len(grams[0]), HELD_GRAMS // 2):
                grams, fresh, waiting = _merged([grams, *fresh]), [], 0
                if len(grams[0]) > HELD_GRAMS:
                    yield gram_rows()
                    grams = empty
            if len(words) > HELD:
                yield word_rows()
                words.clear()
    yield word_rows()
    grams = _merged([grams, *fresh])
    yield gram_rows()
    yield rows(2, pa.nulls(1, pa.binary()), pa.array([0]), [ends])


class Trie:
    """log10 probabilities of every symbol after every context that training saw.

    The whole model in one process, as the definition has it: small corpora alone.
    `contexts` are in the order of `rows`.
    """

    def __init__(self, nodes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for depth in range(ORDER, -1, -1):  # the longest contexts first
            context, symbol = nodes // SYMBOLS, nodes % SYMBOLS
            context = context % SYMBOLS**depth
            keys, back = np.unique(context * SYMBOLS + symbol, return_inverse=True)
            total = np.bincount(back, weights=counts, minlength=len(keys))
            table = {}
            cuts = np.flatnonzero(np.diff(keys // SYMBOLS, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=False):
                table[int(keys[a] // SYMBOLS)] = (keys[a:b] % SYMBOLS, total[a:b])
            self.levels.append(table)
        self.contexts = list(self.levels[0])
        self.rows = np.array([self._row(context) for context in self.contexts])

    def _row(self, context: int) -> np.ndarray:
        left, mass, out = np.ones(SYMBOLS, bool), 1.0, np.zeros(SYMBOLS)
        for depth in range(ORDER + 1):
            found = self.levels[depth].get(context % SYMBOLS ** (ORDER - depth))
            if found is None:
                continue
            symbols, counts = found[0][left[found[0]]], found[1][left[found[0]]]
            if not len(symbols):
                continue
            whole = counts.sum() + len(symbols)
            out[symbols] = mass * counts / whole
            mass *= len(symbols) / whole
            left[symbols] = False
        out[left] = mass / max(left.sum(), 1)
        return np.log10(out)


def _levels(grams: DataFrame) -> DataFrame:
    """(depth, gram, n) for every level of the trie from (node, n) of its longest contexts."""
    modulus = F.element_at(F.array(*[F.lit(SYMBOLS ** (d + 1)) for d in range(ORDER + 1)]), F.col("depth") + 1)
    every = grams.select(F.explode(F.array(*[F.lit(d) for d in range(ORDER + 1)])).alias("depth"), "node", "n")
    return every.groupBy("depth", (F.col("node") % modulus).alias("gram")).agg(F.sum("n").alias("n"))


def _contexts(levels: DataFrame) -> DataFrame:
    """(depth, context, total, symbols, shorter): counts after a context, its different symbols, and those symbols' counts one level below."""
    shorter = levels.select((F.col("depth") + 1).alias("depth"), F.col("gram").alias("lower"), F.col("n").alias("below"))
    modulus = F.element_at(F.array(*[F.lit(SYMBOLS ** max(d, 1)) for d in range(ORDER + 1)]), F.col("depth") + 1)
    rows = levels.withColumn("lower", F.col("gram") % modulus).join(shorter, ["depth", "lower"], "left")
    return rows.groupBy("depth", F.expr(f"gram div {SYMBOLS}").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("below"), F.lit(0)).alias("shorter"))


def _values(wanted: DataFrame, levels: DataFrame, contexts: DataFrame) -> DataFrame:
    """(node, value): log10 probability of each different `node`, seen or not, from its counts at every level.

    A symbol seen after a context is seen after every shorter end of it, so what a
    level excludes is all that the next longer seen context has: `symbols` of them,
    counted `shorter` times here.
    """
    gram, context = SYMBOLS ** (ORDER + 1), SYMBOLS**ORDER
    at = [F.struct(F.lit(d).alias("depth"), (F.col("node") % (gram // SYMBOLS ** (ORDER - d))).alias("gram"),
                   (F.expr(f"node div {SYMBOLS}") % (context // SYMBOLS ** (ORDER - d))).alias("context")) for d in range(ORDER + 1)]
    rows = wanted.select("node", F.inline(F.array(*at)))
    found = []
    for low in (True, False):  # at most 257 ** 2 grams of the two lowest levels; the others have no hot keys
        side = (lambda df: F.broadcast(df.filter("depth < 2"))) if low else (lambda df: df.filter("depth >= 2"))
        part = rows.filter("depth < 2" if low else "depth >= 2")
        found.append(part.join(side(levels), ["depth", "gram"], "left").join(side(contexts), ["depth", "context"], "left"))
    step = F.struct((-F.col("depth")).alias("order"), "n", "total", "symbols", "shorter")
    rows = found[0].unionByName(found[1]).groupBy("node").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    state = lambda value, done, symbols, shorter: F.struct(value.alias("value"), done.alias("done"), symbols.alias("symbols"), shorter.alias("shorter"))

    def go(a, s):
        new = s["symbols"] - a["symbols"]
        whole = s["total"] - a["shorter"] + new
        part = F.when(s["n"].isNotNull(), F.log10(s["n"] / whole)).when(new > 0, F.log10(new / whole)).otherwise(F.lit(0.0))
        return F.when(a["done"] | s["total"].isNull(), a).otherwise(state(a["value"] + part, s["n"].isNotNull(), s["symbols"], s["shorter"]))

    def end(a):
        return F.when(a["done"], a["value"]).otherwise(a["value"] - F.log10(F.lit(SYMBOLS) - a["symbols"]))

    start = state(F.lit(0.0), F.lit(False), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.select("node", F.aggregate("steps", start, go, end).alias("value"))


def _score(model, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, values), known = model.value, head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = text_values(batch.column(2))
            for lo, hi in blocks(texts):
                context, symbol, heads = _symbols(texts[lo:hi])
                node, back = np.unique(context * SYMBOLS + symbol, return_inverse=True)
                at = np.searchsorted(keys, node)
                hit = keys[at] == node
                score = np.add.reduceat(np.where(hit, values[at], 0.0)[back], heads)
                # Grams without a value, once for each text.
                place = np.flatnonzero(~hit[back])
                text = np.searchsorted(heads, place, side="right") - 1
                pairs, times = np.unique(text * len(node) + back[place], return_counts=True)
                rows, rest, sizes, sums, hits = [], [], [], [], []
                for i, text in enumerate(texts[lo:hi]):
                    counts = Counter(text.lower().split())
                    sizes.append(counts.total() + 1)
                    total, hit, other = 0.0, 0, 0
                    for word, n in counts.items():
                        value = known.get(word)
                        if value is None:
                            rest.append((word, n))
                            other += 1
                        else:
                            total += n * value
                            hit += n
                    rows.append(other)
                    sums.append(total)
                    hits.append(hit)
                n = hi - lo
                ids = row + np.arange(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array(sums, pa.float64()), pa.array(score), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                ], names=_PARTS)
                none = lambda m: [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                m = len(rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, rows)), *none(m), pa.array([w for w, _ in rest], pa.binary()), pa.nulls(m, pa.int64()), pa.array([c for _, c in rest], pa.int64())], names=_PARTS)
                m = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs // len(node)]), *none(m), pa.nulls(m, pa.binary()), pa.array(node[pairs % len(node)]), pa.array(times, pa.int64())], names=_PARTS)
                row += n

    return run


_PARTS = ["row", "doc_id", "held_out", "n_tokens", "hit", "logs", "score", "word", "node", "n"]
_PART_TYPES = "row long, doc_id long, held_out boolean, n_tokens long, hit long, logs double, score double, word binary, node long, n long"

_EIGHTH = "floor(log2({}) * 8)"


def _least(counted: DataFrame, column: str, most: int) -> int:
    """From which class on at most `most` rows are left: eighths of powers of two of a count, a few hundred classes."""
    classes = counted.groupBy(F.expr(_EIGHTH.format(column)).alias("e")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("e", ascending=False)
    few = classes["e"][classes["n"].cumsum() <= most]
    return int(few.min()) if len(few) else 1 << 20


def score_documents(documents: DataFrame, held_out) -> DataFrame:
    """Word-unigram and byte-context log10 probabilities of every whole text.

    Reads doc_id and text (other columns are ignored). `held_out` is a column of
    `documents`' columns; rows where it is not true train both models, null counting
    as false. Returns per row doc_id, held_out, n_tokens (words and the end mark),
    n_known (tokens seen in training), train_tokens, base_score (add-one estimate
    over the V different training tokens and one unseen) and score (the trie's
    log10 probability of the text's bytes and end). A null text is empty. Without
    training rows every token is unseen and every byte equally likely.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = docs.filter(~F.col("held_out")).select("text").mapInArrow(_count, _COUNTS).groupBy("kind", "word", "node").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    words = counts.filter("kind = 0").select("word", F.col("n").alias("c"))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_train, n_words = total[0] + ends, total[1] + (ends > 0)
    base = float(np.log10(n_train + n_words + 1))
    eighth, least = F.expr(_EIGHTH.format("c")), _least(words, "c", HEAD)
    head = words.filter(eighth >= least).select("word", F.log10(F.col("c") + 1).alias("value")).toArrow()
    top = dict(zip(head["word"].to_pylist(), head["value"].to_pylist(), strict=True))

    grams = counts.filter("kind = 1").select("node", "n")
    levels = staged(_levels(grams), "levels")
    contexts = staged(_contexts(levels), "contexts")
    seen = grams.withColumn("context", F.expr(f"node div {SYMBOLS}")).join(contexts.filter(F.col("depth") == ORDER), "context")
    seen = staged(seen.select("node", "n", F.log10(F.col("n") / (F.col("total") + F.col("symbols"))).alias("value")), "seen")
    common, enough = F.expr(_EIGHTH.format("n")), _least(seen, "n", HEAD_GRAMS)
    frequent = seen.filter(common >= enough).select("node", "value").toArrow()
    order = np.argsort(frequent["node"].to_numpy())
    # A last key above all grams: a search always ends at a key.
    model = np.append(frequent["node"].to_numpy()[order], np.int64(1 << 62)), np.append(frequent["value"].to_numpy()[order], 0.0)

    context = spark.sparkContext
    parts = staged(docs.select("doc_id", "held_out", "text").mapInArrow(_score(context.broadcast(model), context.broadcast(top)), _PART_TYPES), "parts")
    tail = words.filter(eighth < least)
    rest = parts.filter("word IS NOT NULL").select("row", "word", "n").join(tail, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("hit_more"), F.sum(F.col("n") * F.coalesce(F.log10(F.col("c") + 1), F.lit(0.0))).alias("logs_more"))
    open_grams = parts.filter("node IS NOT NULL").select("row", "node", "n")
    rare = seen.filter(common < enough).select("node", "value")
    unseen = open_grams.select("node").distinct().join(rare, "node", "left_anti")
    values = rare.unionByName(staged(_values(unseen, levels, contexts), "unseen"))
    more = open_grams.join(values, "node").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("score_more"))
    end = float(np.log10(ends + 1))
    rows = parts.filter("word IS NULL AND node IS NULL").drop("word", "node", "n").join(rest, "row", "left").join(more, "row", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hit") + F.coalesce("hit_more", F.lit(0)) + F.lit(1 if ends > 0 else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("logs_more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )
