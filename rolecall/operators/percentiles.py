"""Exact interpolated percentiles that never gather a group's values in one task.

A built-in exact percentile keeps every distinct value of a group in one
aggregation buffer, which a hot group outgrows. Here values are first counted
(the shuffle key includes the value, so a hot group spreads out), a histogram of
fixed-width buckets says which bucket holds each wanted rank, and only those
buckets are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], bucket_width: float
) -> DataFrame:
    """One row per group: `n` and one double column per entry of `probs` (name -> fraction)."""
    counted = (
        df.select(*keys, value.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.floor(F.col("_v") / bucket_width))
    )
    histogram = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    ordered = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    histogram = histogram.withColumn("_upto", F.sum("_bc").over(ordered)).withColumn("n", F.sum("_bc").over(whole))

    wanted = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n") - 1)
        lower = F.floor(position)
        weight = position - lower
        wanted.append(F.struct(F.lit(name).alias("name"), lower.alias("rank"), (F.lit(1.0) - weight).alias("weight")))
        wanted.append(F.struct(F.lit(name).alias("name"), F.ceil(position).alias("rank"), weight.alias("weight")))
    start = F.col("_upto") - F.col("_bc")
    here = F.filter(
        F.array(*wanted), lambda w: (w["weight"] > 0) & (w["rank"] >= start) & (w["rank"] < F.col("_upto"))
    )
    targets = histogram.select(*keys, "_b", "n", start.alias("_start"), here.alias("_ranks")).filter(F.size("_ranks") > 0)

    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.join(targets, [*keys, "_b"]).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    hits = ranked.select(
        *keys,
        "n",
        "_v",
        F.filter(
            "_ranks", lambda w: (w["rank"] >= F.col("_end") - F.col("_c")) & (w["rank"] < F.col("_end"))
        ).alias("_hit"),
    ).select(*keys, "n", "_v", F.explode("_hit").alias("_hit"))
    parts = F.col("_v") * F.col("_hit.weight")
    return hits.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.sum(F.when(F.col("_hit.name") == name, parts)).alias(name) for name in probs],
    )
