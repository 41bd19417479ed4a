"""Connected components of an undirected graph given as an edge table.

Alternates the large-star and small-star steps of Kiveris et al. (2014): every
round is two aggregates and two joins over the edges, and the number of rounds
grows with the logarithm of the component size. No component is ever gathered
in one place, and each round is written to the shared folder, so a lost executor
costs one round. The write itself counts the rows that tell whether to go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rolecall.session import scratch_path


def _star(edges: DataFrame, toward: DataFrame) -> DataFrame:
    """Re-hang neighbours in `toward` (u, v) on the smallest node seen from u."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return toward.join(smallest, "u")


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """One (u, v) row per named column pair of each row."""
    rows = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
    return df.select(F.inline(rows))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    moved = _star(both, both.filter(F.col("v") > F.col("u")))
    return _pairs(moved, ("v", "m"))  # the next step drops what repeats


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    moved = _star(edges, edges)
    return _pairs(moved, ("v", "m"), ("u", "m")).filter(F.col("u") != F.col("v")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table in the shared folder, and a fingerprint of them."""
    seen = Observation()
    path = scratch_path(edges.sparkSession, "components")
    told = edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    told.write.parquet(path)
    table = edges.sparkSession.read.schema(edges.schema).parquet(path)
    return table, (seen.get.get("rows") or 0, seen.get.get("sum"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node."""
    u, v = F.greatest(a, b), F.least(a, b)
    current, before = _written(edges.select(u.alias("u"), v.alias("v")).filter(F.col("u") != F.col("v")).distinct())
    while before[0]:
        current, after = _written(_small_star(_large_star(current)))
        if after == before:
            break
        before = after
    return _pairs(current, ("u", "v"), ("v", "v")).distinct().toDF("node", "root")
