"""Exact Jaccard join of documents on word shingles by partitioned signatures.

Sets are cut into segments of the hashed universe. Two sets of a size band that
are at least as similar as the threshold differ in at most H elements, so of
H + 1 + slack segments all but H are equal. Each document sends one signature
per non-empty segment, for its own band and, if a partner may be smaller, for
the band below.

Costs decide which signatures are compared. A signature that more than FEW
documents hold is dear: a document leaves such segments (and empty ones) out as
long as enough others must be equal. How many must be is known for each document
from its size and the segments it leaves out, so cheap candidates are pairs that
share at least that many cheap signatures. Only documents that would have none
left, such as members of large groups of near copies, are compared inside dear
segments, and only inside as many of their least dear ones as they must share.

Links need not all be seen to join components. First every document is compared
with its smallest cheap candidate, or with the smallest document of each dear
segment; verified links make components, and only candidates of different
components are then compared with each other. A candidate's parity sketch, whose
bits differ at most as often as the sets do, is held against H before the whole
sets decide.

The method also names one-deletion neighbourhoods; the slack takes their place:
a neighbourhood costs one signature per element, a spare segment costs one in
all and buys the same allocation.

Nothing is capped. Buckets grow in number with the text, and a bucket's task
keeps at most FEW documents of a signature, however many hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import blocks, give_back, keep_ids, shuffle_partitions, small_batches, staged, staged_few, text_bytes, text_values
from rolecall.llm.hashing import mix
from rolecall.llm.shingles import shingle_sets
from rolecall.operators.components import connected_components

#: A signature held by more documents than this is dear.
FEW = 8
#: Segments beyond H + 1, as a share of them.
SLACK = 0.2
#: Members of a dear signature that meet as many others at once.
CELL = 1024
#: Text for each bucket of signatures.
BUCKET_BYTES = 8 << 20
#: Signatures a bucket's task sorts at once.
SORT_ROWS = 4_000_000

_U = np.uint64
_PAIR, _DEAR, _META = 0, 1, 2
_SENT = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g array<binary>"
_FOUND = "kind int, a long, b long, c long, d long, e long, f long, g boolean, h binary"


class Bands:
    """Size bands [low, high) and, for each, how many segments sets are cut into.

    `num / den` is the least Jaccard similarity. With x <= y elements a pair has
    y <= x * den / num and differs in at most (x + y) * (den - num) / (den + num).
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, lows[-1] * 7 // 5))
        self.low = np.array(lows, np.int64)
        top = self.low[1:] - 1
        self.reach = top * den // num  # the largest partner of a set in the band
        most = self.differ(top, self.reach)
        self.segments = np.where(most > 0, most + 1 + np.ceil(SLACK * (most + 1)).astype(np.int64) + 2, 0)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most elements in which similar sets of these sizes differ."""
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def spare(self, size: np.ndarray, band: np.ndarray, own: bool) -> np.ndarray:
        """How many segments a set may leave out so that one of the others is equal in every similar set."""
        partner = size * self.den // self.num if own else np.minimum(self.low[band + 1] - 1, size)
        return self.segments[band] - 1 - self.differ(size, partner)


def _signatures(hashes, counts, band, use, own, bands):
    """(signature, document, segments each document may still leave out) for the chosen band of each document."""
    band = np.maximum(band, 0)
    size = np.where(use, bands.segments[band], 0)
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = size[owner] > 0
    h, o = hashes[inside], owner[inside]
    total = int(size.sum())
    key = base[o] + (((h >> _U(32)) * size[o].astype(_U)) >> _U(32)).astype(np.int64)
    sums = np.zeros(total, _U)
    np.add.at(sums, key, mix(h))
    filled = np.bincount(key, minlength=total) > 0
    doc = np.repeat(np.arange(len(counts)), size)
    place = (np.arange(total) - base[doc]).astype(_U)
    sig = mix(sums ^ mix(place + (band[doc].astype(_U) << _U(40))))
    empty = size - np.bincount(doc[filled], minlength=len(counts))
    spare = np.where(size > 0, bands.spare(counts, band, own) - empty, 0)
    sent = filled | (spare < 0)[doc]
    return sig[sent], doc[sent], spare


def _sketches(hashes, counts):
    """Parity sketches: bit h mod b tells whether an odd number of elements falls on it, b a power of two near the size."""
    out, at = [], 0
    for n in counts.tolist():
        bits = max(64, 1 << n.bit_length())
        odd = np.bincount((hashes[at : at + n] & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        at += n
    return out


def _sketch_distance(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, the longer one folded to the shorter: at most as many as differing elements."""
    x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def _rows(buckets: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            no_id = np.array(ids.is_null())
            doc = np.array(ids.fill_null(0), np.int64)
            texts = text_values(batch.column(1))
            copies: set[tuple[int, int, int]] = set()
            for lo, hi in blocks(texts):
                hashes, counts = shingle_sets(texts[lo:hi])
                edges = np.concatenate([[0], np.cumsum(counts)])
                one, two = (np.concatenate([[_U(0)], np.cumsum(mix(hashes ^ _U(k)))]) for k in (0x51ED270B, 0xC2B2AE35))
                one, two = one[edges[1:]] - one[edges[:-1]], two[edges[1:]] - two[edges[:-1]]
                use = ~no_id[lo:hi] & (counts > 0)
                for i, key in enumerate(zip(counts.tolist(), one.tolist(), two.tolist(), strict=True)):
                    if use[i]:
                        use[i] = key not in copies  # copies in a batch send their signatures once
                        copies.add(key)
                band = bands.of(np.maximum(counts, 1))
                below = use & (band > 0) & (counts <= bands.reach[np.maximum(band - 1, 0)])
                sig_a, doc_a, spare_a = _signatures(hashes, counts, band, use, True, bands)
                sig_b, doc_b, spare_b = _signatures(hashes, counts, band - 1, below, False, bands)
                sig = np.concatenate([sig_a, sig_b])
                at = np.concatenate([doc_a, doc_b])
                own = np.concatenate([np.ones(len(sig_a), np.int8), np.zeros(len(sig_b), np.int8)])
                bucket = (sig % _U(buckets)).astype(np.int32)
                order = np.lexsort((at, bucket))
                bucket, sig, at, own = bucket[order], sig[order], doc[lo:hi][at[order]], own[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
                out = [
                    (int(bucket[a]), _DEAR, sig[a:b].tobytes(), at[a:b].tobytes(), own[a:b].tobytes(), None, None, None, None)
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                ]
                out.append((
                    int(doc[lo] % buckets), _META, doc[lo:hi].tobytes(), counts.tobytes(), one.tobytes(), two.tobytes(),
                    np.stack([spare_a, spare_b]).astype(np.int64).tobytes(), no_id[lo:hi].tobytes(), _sketches(hashes, counts),
                ))
                yield _batch(out)
        give_back()

    return run


_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcdef"], ("g", pa.list_(pa.binary()))])
_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in "abcdef"], ("g", pa.bool_()), ("h", pa.binary())])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_SCHEMA, strict=True)], schema=_SENT_SCHEMA)


def _out(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND_SCHEMA)


def _grouped(sig, doc, own):
    """Sorted by signature and document, each (signature, document) once, with the length of its group."""
    order = np.lexsort((doc, sig))
    sig, doc, own = sig[order], doc[order], own[order]
    if len(sig):
        first = np.ones(len(sig), bool)
        first[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc, own = sig[first], doc[first], own[first]
    heads = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([heads, [len(sig)]]))
    return sig, doc, own, np.repeat(lengths, lengths)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted pairs of cheap signatures, memberships of dear ones, and the documents' facts, of some buckets."""
    kept = [np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int8)]
    dear = np.zeros(0, _U)
    more: list[tuple] = []
    waiting = 0

    def settle():
        nonlocal kept, dear, more, waiting
        sig, doc, own = (np.concatenate([x, *part]) for x, part in zip(kept, zip(*more, strict=True) if more else ((), (), ()), strict=True))
        more, waiting = [], 0
        sig, doc, own, length = _grouped(sig, doc, own)
        out = (length > FEW) | np.isin(sig, dear)
        dear = np.unique(np.concatenate([dear, sig[out]]))
        kept = [sig[~out], doc[~out], own[~out]]
        return _out(_DEAR, int(out.sum()), a=doc[out], b=sig[out].view(np.int64), c=own[out].astype(np.int64))

    for batch in batches:
        kinds = batch.column(1).to_pylist()
        for i, kind in enumerate(kinds):
            a, b, c, d, e, f, g = (batch.column(k)[i].as_py() for k in range(2, 9))
            if kind == _META:
                spare = np.frombuffer(e, np.int64).reshape(2, -1)
                columns = dict(zip("abcd", (np.frombuffer(x, np.int64) for x in (a, b, c, d)), strict=True))
                yield _out(_META, spare.shape[1], e=spare[0], f=spare[1], g=np.frombuffer(f, bool), h=g, **columns)
                continue
            more.append((np.frombuffer(a, _U), np.frombuffer(b, np.int64), np.frombuffer(c, np.int8)))
            waiting += len(more[-1][0])
            if waiting > SORT_ROWS:
                yield settle()
    yield settle()
    sig, doc, own, _ = _grouped(*kept)
    parts = []
    for lag in range(1, FEW):
        same = np.flatnonzero(sig[lag:] == sig[:-lag]) if len(sig) > lag else np.zeros(0, np.int64)
        parts.append((doc[same], doc[same + lag], own[same], own[same + lag]))
    a, b, own_a, own_b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((own_b, own_a, b, a))
    a, b, own_a, own_b = a[order], b[order], own_a[order].astype(np.int64), own_b[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (own_a[1:] != own_a[:-1]) | (own_b[1:] != own_b[:-1])])) if len(a) else np.zeros(0, np.int64)
    yield _out(_PAIR, len(heads), a=a[heads], b=b[heads], c=np.diff(np.append(heads, len(a))), d=own_a[heads], e=own_b[heads])
    del sig, doc, own, parts, kept, a, b, own_a, own_b, order
    give_back()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_values(batch.column(1))
        doc = batch.column(0)
        for lo, hi in blocks(texts):
            hashes, counts = shingle_sets(texts[lo:hi])
            edges = np.concatenate([[0], np.cumsum(counts)])
            sets = [hashes[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["node", "members"])


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "x", "y"))
            keep = [_sketch_distance(p, q) <= (n + m) * (den - num) // (den + num) for n, m, p, q in zip(n_a, n_b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(x, y, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of two lists of (rep, n, comp, sketch) that sizes, components and sketches allow."""
    out = []
    lengths = sorted({len(r[3]) for r in x} | {len(r[3]) for r in y})
    for size in lengths:  # sizes of similar sets differ so little that sketches are as long or twice as long
        def side(rows, size=size):
            rows = [r for r in rows if len(r[3]) in (size, 2 * size)]
            bits = np.zeros((len(rows), size // 8), _U)
            for k, r in enumerate(rows):
                words = np.frombuffer(r[3], _U)
                bits[k] = words if len(r[3]) == size else words[: size // 8] ^ words[size // 8 :]
            facts = np.array([r[:3] for r in rows], np.int64).reshape(-1, 3)
            return bits, facts, np.array([len(r[3]) == size for r in rows], bool)

        (p, f, short), (q, g, brief) = side(x), side(y)
        both = f[:, 1][:, None] + g[:, 1][None]
        may = (f[:, 2][:, None] != g[:, 2][None]) & (short[:, None] | brief[None])
        may &= num * np.maximum(f[:, 1][:, None], g[:, 1][None]) <= den * np.minimum(f[:, 1][:, None], g[:, 1][None])
        i, j = np.nonzero(may)
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            apart = np.zeros(len(a), np.int64)
            for k in range(p.shape[1]):
                apart += np.bitwise_count(p[a, k] ^ q[b, k])
            ok = apart <= both[a, b] * (den - num) // (den + num)
            out += zip(np.minimum(f[a[ok], 0], g[b[ok], 0]).tolist(), np.maximum(f[a[ok], 0], g[b[ok], 0]).tolist(), strict=True)
    return out


def _met(num: int, den: int):
    """Candidates among rows sorted by cell pair and side; at most two cells are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, found = None, ([], []), set()

        def rows():
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for sig, i, j, side, *facts in zip(*columns, strict=True):
                if key != (sig, i, j):
                    found.update(_near(*sides, num, den))
                    key, sides = (sig, i, j), ([], [])
                sides[side].append(facts)
            if len(found) > 100_000:
                yield rows()
        found.update(_near(*sides, num, den))
        yield rows()

    return run


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; those whose sketches rule it out go first."""
    for end, sketch in (("a", "x"), ("b", "y")):
        pairs = classes.filter("doc = rep").select(F.col("doc").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(sketch)).join(pairs, end)
    pairs = staged(pairs.mapInArrow(_possible(num, den), "a long, b long").distinct(), "possible")
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = staged(keep_ids(docs, nodes, "doc_id").mapInArrow(_set_rows, "node long, members binary"), "sets")
    x, y = (sets.select(F.col("node").alias(k), F.col("members").alias(m)) for k, m in (("a", "x"), ("b", "y")))
    return staged(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(num, den), "a long, b long").distinct(), "links")


def jaccard_components(documents: DataFrame, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Near copies of whole texts: one row per row of `documents` (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by
    links. Null or blank texts have no shingles and link with nothing; a row
    without doc_id gets its n_shingles and a null component. Rows that share a
    doc_id are one node, linked wherever one of them is. An empty table gives none.
    """
    num, den = threshold
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = Bands(num, den)
    buckets = int(max(2 * shuffle_partitions(spark), text_bytes(docs) // BUCKET_BYTES + 1))
    sent = docs.mapInArrow(_rows(buckets, bands), _SENT).repartition(buckets, "bucket")
    found = staged(sent.mapInArrow(_found, _FOUND), "jaccard")

    meta = found.filter(f"kind = {_META}").select(
        F.expr("CASE WHEN NOT g THEN a END").alias("doc"), F.col("b").alias("n"), "c", "d",
        F.col("e").alias("spare_own"), F.col("f").alias("spare_below"), F.col("h").alias("sketch"),
    )
    known = meta.filter("doc IS NOT NULL AND n > 0")
    smallest = known.groupBy("n", "c", "d").agg(F.min("doc").alias("rep"))
    dear = found.filter(f"kind = {_DEAR}").select(F.col("a").alias("doc"), F.col("b").alias("sig"), (F.col("c") == 1).alias("own"))
    held = dear.groupBy("doc").agg(F.count_if("own").alias("dear_own"), F.count_if(~F.col("own")).alias("dear_below"))
    # left_*: the cheap signatures that every similar set must share; none or fewer: the dear ones count.
    classes = known.join(smallest, ["n", "c", "d"]).join(held, "doc", "left").select(
        "doc", "rep", "n", "sketch",
        (F.col("spare_own") + 1 - F.coalesce("dear_own", F.lit(0))).alias("left_own"),
        (F.col("spare_below") + 1 - F.coalesce("dear_below", F.lit(0))).alias("left_below"),
    )
    classes = staged(classes.dropDuplicates(["doc", "rep"]), "classes")
    several = classes.groupBy("doc").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    same_id = classes.join(several.select("doc", "a"), "doc").select("a", F.col("rep").alias("b")).filter("a <> b")

    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    fits = f"a <> b AND {num} * greatest(n_a, n_b) <= {den} * least(n_a, n_b)"
    cheap = found.filter(f"kind = {_PAIR}").groupBy("a", "b", F.col("d").alias("own_a"), F.col("e").alias("own_b")).agg(F.sum("c").alias("shared"))
    for end in ("a", "b"):
        must = F.when(F.col(f"own_{end}") == 1, F.col("left_own")).otherwise(F.col("left_below"))
        facts = classes.select(F.col("doc").alias(end), F.col("rep").alias(f"rep_{end}"), F.col("n").alias(f"n_{end}"), "left_own", "left_below")
        cheap = cheap.join(facts, end).withColumn(f"must_{end}", must).drop("left_own", "left_below")
    cheap = cheap.filter("shared >= greatest(1, must_a, must_b)").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b")
    cheap = staged(cheap.filter(fits).select(*ordered).distinct(), "cheap")

    over = classes.select("doc", "rep", "n", F.inline(F.array(F.struct(F.lit(True).alias("own"), F.col("left_own").alias("left")), F.struct(F.lit(False).alias("own"), F.col("left_below").alias("left")))))
    least = Window.partitionBy("doc", "own").orderBy("k", "sig")
    dear = dear.join(over.filter("left < 1"), ["doc", "own"]).join(dear.groupBy("sig").agg(F.count(F.lit(1)).alias("k")), "sig")
    dear = dear.withColumn("_r", F.row_number().over(least)).filter("_r <= 1 - left")
    dear = staged(dear.select("sig", "rep", "n").distinct(), "dear")
    pivot = dear.groupBy("sig").agg(F.min(F.struct("rep", "n")).alias("p")).select("sig", F.col("p.rep").alias("a"), F.col("p.n").alias("n_a"))
    star = dear.join(pivot, "sig").select("a", "n_a", F.col("rep").alias("b"), F.col("n").alias("n_b")).filter(fits).select(*ordered)
    pairs = staged_few(cheap.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(star).distinct(), "pairs")
    links = _verify(docs, classes, pairs, num, den).union(same_id)
    roots = staged_few(connected_components(links), "roots")

    def component(end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))

    def apart(pairs: DataFrame) -> DataFrame:
        placed = pairs.join(component("a"), "a", "left").join(component("b"), "b", "left")
        return placed.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")

    seen = dear.join(component("rep"), "rep", "left").withColumn("comp", F.coalesce("root_rep", "rep")).drop("root_rep")
    main = seen.groupBy("sig").agg(F.min_by("comp", "rep").alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo < hi")
    mixed = seen.join(main.select("sig", "main", F.ceil(F.col("k") / CELL).cast("int").alias("cells")), "sig")
    mixed = mixed.join(classes.filter("doc = rep").select("rep", "sketch"), "rep").withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    facts = ["rep", "n", "comp", "sketch"]
    asking = mixed.filter("comp <> main").select("sig", F.col("cell").alias("i"), every.alias("j"), F.lit(0).alias("side"), *facts)
    asked = mixed.select("sig", every.alias("i"), F.col("cell").alias("j"), F.lit(1).alias("side"), *facts)
    met = asking.union(asked).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side")
    across = met.mapInArrow(_met(num, den), "a long, b long")
    rest = staged_few(apart(cheap).union(across).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    late = _verify(docs, classes, rest, num, den)
    for end in ("a", "b"):
        late = late.join(component(end), end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    merged = staged_few(connected_components(late), "merged").select(F.col("node").alias("root"), F.col("root").alias("_root"))
    nodes = roots.unionByName(merged.select(F.col("root").alias("node"), "root")).distinct()
    roots = staged_few(nodes.join(merged, "root", "left").select("node", F.coalesce("_root", "root").alias("root")), "roots")

    placed = classes.groupBy("doc").agg(F.min("rep").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("doc", F.coalesce("root", "rep").alias("component"))
    return meta.join(placed, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component_id")
    )
