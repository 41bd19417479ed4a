"""Merkle manifest of a table: a tree of SHA-256 digests whose parents keep their hash states.

Every row is a leaf. The leaves of a group stand in order, and every FAN of them
become one parent, level by level, until one node is left: the group's subroot. The
subroots become the root in the same way. A parent's digest is the hash of its
children's digests one after the other, so the state before each child's slot says
all about the children to its left. Parents retain a copy of it: to fold a replaced
child, a parent goes on from the copy at that slot with the replacement and the
children to its right.

A few levels at a time are built in one task, from a chunk of FAN ** levels leaves that
stand next to each other in a group, whatever the group's size. Each pass leaves one
node of a chunk; what a node needs to reach the root, its siblings level by level, comes back
down the same way, one row for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import small_batches, staged, staged_few

#: Children of a node, and levels that are built at a time.
FAN, LEVELS = 16, 3

_STEPS = "array<struct<left: string, right: string>>"


class Parent:
    """A node of up to FAN children that remembers its hash state before each child."""

    def __init__(self, children: list[bytes]):
        self.children, self.states = children, []
        whole = hashlib.sha256()
        for child in children:
            self.states.append(whole.copy())
            whole.update(child)
        self.digest = whole.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child at `slot`."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(b"".join(self.children[slot + 1 :]))
        return state.hexdigest().encode()


class Tree:
    """A chunk of nodes and the levels above them: all `levels` where the group has more nodes, else up to one node."""

    def __init__(self, nodes: list[bytes], whole_group: bool, levels: int):
        self.levels = []
        while len(nodes) > 1 if whole_group else len(self.levels) < levels:
            parents = [Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
            self.levels.append(parents)
            nodes = [p.digest for p in parents]
        self.digest = nodes[0]

    def steps(self, place: int) -> Iterator[tuple[Parent, int]]:
        """(parent, slot) of every level above a leaf."""
        for parents in self.levels:
            place, slot = divmod(place, FAN)
            yield parents[place], slot


class Step:
    """One level above a chunk: the state behind the left siblings serves all its rows."""

    def __init__(self, left: str, right: str):
        self.left, self.right = left.encode(), right.encode()
        self.state = hashlib.sha256(self.left)

    def fold(self, replacement: bytes) -> bytes:
        state = self.state.copy()
        state.update(replacement)
        state.update(self.right)
        return state.hexdigest().encode()


def _trees(batch: pa.RecordBatch, levels: int) -> Iterator[tuple[dict, Tree]]:
    for row in batch.to_pylist():
        yield row, Tree([r["leaf"].encode() for r in row["rows"]], row["n"] <= FAN**levels, levels)


def _digests(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("digest", pa.array([tree.digest.decode() for _, tree in _trees(batch, levels)], pa.string()))

    return run


_ABOVE = f"branch string, chunk long, pass int, subroot string, root string, steps {_STEPS}"
_ABOVE_ARROW = pa.schema([
    ("branch", pa.string()), ("chunk", pa.int64()), ("pass", pa.int32()), ("subroot", pa.string()), ("root", pa.string()),
    ("steps", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
])


def _downwards(top: bool, levels: int):
    """What the children of every chunk need to reach the root; the children of the topmost tree are subroots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tree in _trees(batch, levels):
                out = []
                for i, child in enumerate(row["rows"]):
                    pairs = [parent.siblings(slot) for parent, slot in tree.steps(i)]
                    steps = [{"left": a.decode(), "right": b.decode()} for a, b in pairs] + row["steps"]
                    if top:
                        out.append({"branch": child["branch"], "chunk": 0, "pass": child["pass"], "subroot": child["leaf"], "root": row["root"], "steps": steps})
                    else:
                        out.append({"branch": row["branch"], "chunk": child["place"], "pass": row["pass"] - 1, "subroot": row["subroot"], "root": row["root"], "steps": steps})
                yield pa.RecordBatch.from_pylist(out, schema=_ABOVE_ARROW)

    return run


_FOLDED = f"id string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, siblings {_STEPS}"
_FOLDED_ARROW = pa.schema([
    ("id", pa.string()), ("place", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("siblings", _ABOVE_ARROW.field("steps").type),
])


def _fold(with_siblings: bool, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tree in _trees(batch, levels):
                above = [Step(**s) for s in row["steps"]]
                shared = b"".join(s.left + s.right for s in above)
                out = []
                for i, child in enumerate(row["rows"]):
                    node = (child["replaced"] or child["leaf"]).encode()
                    proof = hashlib.sha256()
                    siblings = []
                    for parent, slot in tree.steps(i):
                        node = parent.fold(slot, node)
                        left, right = parent.siblings(slot)
                        proof.update(left)
                        proof.update(right)
                        if with_siblings:
                            siblings.append({"left": left.decode(), "right": right.decode()})
                    for step in above:
                        node = step.fold(node)
                    proof.update(shared)
                    out.append({
                        "id": child["id"], "place": child["place"], "leaf": child["leaf"], "subroot": row["subroot"], "root": row["root"], "proof_sha256": proof.hexdigest(),
                        "folded_root": node.decode(), "siblings": siblings + row["steps"] if with_siblings else None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_FOLDED_ARROW)

    return run


def row_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of values, each `-` if null, else its UTF-8 byte count, a colon and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with their place in their branch, from 0, and n, the branch's rows.

    Rows are dealt by ranges of (branch, order) and counted per range, so a branch of
    any size is many tasks, and rows alike in all of it are dealt by their origin.
    """
    dealt = rows.withColumn("_origin", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    keys = ["branch", *order, "_origin"]
    sorted_rows = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_origin")
    placed = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "leaves").withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.groupBy("branch", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    branch = Window.partitionBy("branch")
    before = branch.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("branch", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(branch).alias("n"))
    found = placed.join(staged_few(ranges, "ranges"), ["branch", "_part"])
    return found.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _chunks(rows: DataFrame, levels: int) -> DataFrame:
    """(branch, chunk, n, rows, digest): neighbours of a branch and the node that they become."""
    inner = F.struct(F.col("place"), *[F.col(c) for c in rows.columns if c not in ("place", "n", "branch", "_above")], *([F.col("_above").alias("branch")] if "_above" in rows.columns else []))
    packed = rows.groupBy("branch", F.expr(f"place div {FAN**levels}").alias("chunk"), "n").agg(F.array_sort(F.collect_list(inner)).alias("rows"))
    types = ", ".join(f"{name} {kind}" for name, kind in packed.dtypes)
    return staged(packed.mapInArrow(_digests(levels), f"{types}, digest string"), "chunks")


def _passes(rows: DataFrame, levels: int) -> list[DataFrame]:
    """The chunks of every pass, from the leaves up, until each branch has one node."""
    chunk = FAN**levels
    found = [_chunks(rows, levels)]
    while True:
        more = found[-1].filter(f"n > {chunk}").select("branch", F.col("chunk").alias("place"), F.expr(f"(n + {chunk - 1}) div {chunk}").alias("n"), F.col("digest").alias("leaf"))
        if more.isEmpty():
            return found
        found.append(_chunks(more, levels))


def _with_above(chunks: DataFrame, above: DataFrame) -> DataFrame:
    return chunks.join(above, ["branch", "chunk"]).select("branch", "chunk", "n", "rows", "pass", "subroot", "root", "steps")


def _sent_down(rows: DataFrame, top: bool, levels: int) -> DataFrame:
    return staged(rows.mapInArrow(_downwards(top, levels), _ABOVE), "above")


def merkle_manifest(documents: DataFrame, columns: list[str], key: str, group: str, tampered: Column | None = None, replacements: dict[str, Column] | None = None, siblings: bool = False, levels: int = LEVELS) -> DataFrame:
    """One row per row of `documents`: its leaf, the subroot and root above it, its proof, and its fold.

    A leaf is `row_digest` of `columns`. Leaves of a `group` ascend by `key`, null
    first, rows that share a key by their leaf; groups ascend by the bytes of their
    text, the null group first. Where `tampered` is true the leaf is hashed anew with
    `replacements` for some columns, and folded_root is the root that this leaf and
    the original siblings lead to; elsewhere the original leaf is folded. Returns
    `key`, place (in its group, from 0), leaf, subroot,
    root, proof_sha256 (the hash of all siblings, level by level, left to right),
    folded_root, verified, and with `siblings` the siblings of every level. `levels`
    levels are built at a time: a task holds FAN ** levels leaves.

    An empty table has no rows and no root. A lone leaf is its subroot, a lone subroot
    the root. Repeated rows are leaves of their own. Other columns are ignored; texts
    of any length are hashed where they are read and do not travel.
    """
    small_batches(documents.sparkSession)
    leaf = row_digest(*[F.col(f"`{c}`") for c in columns])
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered, row_digest(*[(replacements or {}).get(c, F.col(f"`{c}`")) for c in columns]))
    branch = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    rows = documents.select(branch.alias("branch"), F.col(f"`{key}`").alias("id"), leaf.alias("leaf"), other.alias("replaced"))
    passes = _passes(_numbered(rows, ["id", "leaf"]).withColumn("id", F.col("id").cast("string")), levels)

    roots = [chunks.filter(f"n <= {FAN**levels}").select(F.col("branch").alias("_above"), F.lit(i).alias("pass"), F.col("digest").alias("leaf")) for i, chunks in enumerate(passes)]
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    top = _passes(_numbered(subroots.withColumn("branch", F.lit("")), ["_above"]), levels)
    above = top[-1].select("branch", "chunk", F.lit(len(top) - 1).alias("pass"), F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"))
    for i in range(len(top) - 1, -1, -1):
        rows_above = _with_above(top[i], above)
        if i:  # nodes of an upper pass have no group of their own
            above = _sent_down(rows_above, False, levels)
        else:
            ends = _sent_down(rows_above, True, levels)
    above = None
    for i in range(len(passes) - 1, -1, -1):
        here = ends.filter(F.col("pass") == i)
        above = here if above is None else here.unionByName(above)
        if i:
            above = _sent_down(_with_above(passes[i], above), False, levels)
    folded = _with_above(passes[0], above).mapInArrow(_fold(siblings, levels), _FOLDED)
    found = folded.select(F.col("id").cast(documents.schema[key].dataType).alias(key), "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "siblings")
    return found if siblings else found.drop("siblings")
