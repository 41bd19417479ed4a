"""Nearest neighbours through a few stable projections, with a chi-square stopping test.

Every vector is projected on M Gaussian directions. For a pair at distance d the
squared projected distance over d squared follows a chi-square law with M degrees
of freedom, so once projected neighbours have been verified in order up to
`sqrt(quantile) * d_k`, with d_k the k-th best distance so far, a nearer vector
is still missing with at most the chosen probability.

The projected space is cut by a kd-tree whose medians come from a bounded sample;
its leaves are the tasks' cells and every vector is in one. A query first visits
its own leaf, which bounds d_k, then all leaves that its stopping radius reaches.
In a leaf neighbours are taken by projected distance until the test holds.

Copies of a vector are the same point: only the k + 1 smallest ids of each can
ever be answers, so a vector that many rows share does not fill a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import small_batches, staged

#: Projections, and the stopping test's confidence.
M, CONFIDENCE = 8, 0.97
#: Rows that the tree's medians are taken from, and vectors in a leaf.
SAMPLE, LEAF = 50_000, 2_000
#: Queries that meet a leaf in one task.
QUERY_BLOCK = 2_000
#: Projected neighbours verified at once.
STEP = 256
SEED = 7


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable with an even number of degrees stays below with probability p."""
    low, high = 0.0, 40.0 * degrees
    for _ in range(100):
        x = (low + high) / 2
        term = total = math.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


class Tree:
    """A kd-tree over the projected space: split planes only, so that any point has a leaf."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.axis = np.zeros((1 << self.depth) - 1, np.int64)
        self.cut = np.zeros((1 << self.depth) - 1)
        groups = [points]
        for level in range(self.depth):
            below = []
            for i, group in enumerate(groups):
                node = (1 << level) - 1 + i
                if len(group):
                    self.axis[node] = np.argmax(group.max(axis=0) - group.min(axis=0))
                    self.cut[node] = np.median(group[:, self.axis[node]])
                right = group[:, self.axis[node]] > self.cut[node]
                below += [group[~right], group[right]]
            groups = below

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def reached(self, point: np.ndarray, radius: float) -> list[int]:
        """Leaves whose box comes within `radius` of the point."""
        found, open_nodes = [], [(0, np.zeros(len(point)))]
        inner = (1 << self.depth) - 1
        while open_nodes:
            node, away = open_nodes.pop()
            if node >= inner:
                found.append(node - inner)
                continue
            axis = self.axis[node]
            gap = point[axis] - self.cut[node]
            near = 2 * node + 1 + (gap > 0)
            open_nodes.append((near, away))
            far = away.copy()
            far[axis] = max(far[axis], abs(gap))
            if (far**2).sum() <= radius**2:
                open_nodes.append((4 * node + 3 - near, far))
        return found


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if isinstance(column, pd.Series) else column, np.float64)


def nearest_in_leaf(query, point, vectors, points, ids, own, k, quantile):
    """The leaf's answers to one query: (ids, distances), by projected distance until the test holds."""
    projected = np.sqrt(((points - point) ** 2).sum(axis=1))
    order = np.argsort(projected, kind="stable")
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(order), STEP):
        if len(best) == k and projected[order[at]] > math.sqrt(quantile) * best[-1]:
            break
        chosen = order[at : at + STEP]
        chosen = chosen[ids[chosen] != own]
        distance = np.sqrt(((vectors[chosen] - query) ** 2).sum(axis=1))
        best_id, best = np.concatenate([best_id, ids[chosen]]), np.concatenate([best, distance])
        top = np.lexsort((best_id, best))[:k]
        best_id, best = best_id[top], best[top]
    return best_id, best


def _search(directions: np.ndarray, k: int, quantile: float):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            vectors, ids = _matrix(rows["vector"]), rows["vec_id"].to_numpy()
            points = vectors @ directions
            asked = _matrix(queries["vector"])
            for own, query, point in zip(queries["query_id"], asked, asked @ directions, strict=True):
                found, distance = nearest_in_leaf(query, point, vectors, points, ids, own, k, quantile)
                out += zip([own] * len(found), found.tolist(), distance.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


_ANSWERS = "query_id long, vec_id long, score double"


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found rows of every row whose vec_id is divisible by `every`.

    Reads vec_id and embedding (other columns are ignored). Null, empty and zero
    vectors, and vectors with null or non-finite components, take no part, nor do
    rows without vec_id or, should lengths differ, vectors of another than the most
    frequent length (the smaller of equals). Distance is Euclidean in double
    precision; ties go to the smaller vec_id. Repeated vec_ids count once for each
    different vector; a query never finds its own vec_id.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    vector = F.col("embedding").cast("array<double>")
    ok = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(ok)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == size["size"])
    first = Window.partitionBy("vector").orderBy("vec_id")
    points = staged(rows.distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n"), "points")
    number = points.count()
    directions = np.random.default_rng(SEED).standard_normal((size["size"], M))
    sample = points.select("vector").sample(fraction=min(1.0, 1.2 * SAMPLE / number), seed=SEED).limit(SAMPLE).toPandas()
    fitted = _matrix(sample["vector"]) @ directions if len(sample) else np.zeros((0, M))
    tree = Tree(fitted, min(math.ceil(number / LEAF), max(1, len(sample) // 8)))
    quantile = chi_square_quantile(CONFIDENCE, M)
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    # The sample bounds the number of leaves; fuller leaves are searched in parts.
    parts = max(1, math.ceil(number / (LEAF << (tree.depth + 1))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected = _matrix(batch.column(1).to_pylist()).reshape(-1, len(directions)) @ directions
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaf(projected))], names=[*batch.schema.names, "leaf"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected = _matrix(batch.column(1).to_pylist()).reshape(-1, len(directions)) @ directions
            leaves = [tree.reached(p, math.sqrt(quantile) * d) for p, d in zip(projected, batch.column(2).to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.array([x for y in leaves for x in y], np.int64))], names=["query_id", "vector", "leaf"])

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    leaves = staged(points.mapInArrow(placed, "vec_id long, vector array<double>, leaf long"), "leaves")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")
    copies = leaves.select("vec_id", "vector", "leaf", part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def answers(queries: DataFrame) -> DataFrame:
        queries = queries.select("query_id", "vector", "leaf", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        keys = ["leaf", "block", "part"]
        return copies.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(directions, k, quantile), _ANSWERS)

    home = staged(answers(asked.mapInArrow(placed, "query_id long, vector array<double>, leaf long")), "home")
    by_rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    bound = home.distinct().withColumn("_n", F.row_number().over(by_rank)).groupBy("query_id").agg(F.max(F.when(F.col("_n") == k, F.col("score"))).alias("bound"))
    reach = asked.join(bound, "query_id", "left").select("query_id", "vector", F.coalesce("bound", F.lit(float("inf"))))
    found = answers(reach.mapInArrow(spread, "query_id long, vector array<double>, leaf long"))
    ranked = found.distinct().withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
