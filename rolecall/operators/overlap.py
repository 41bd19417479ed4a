"""How many rows of one table share a value with each row of another, without listing the pairs.

Rows with the same set of values are counted as one. Of the values that two sets
share, the one most common in the first table owns the pair, so a pair counts where
neither set has a still more common value that the other has as well. What decides
that is not the whole set but what stands before the value when the set is ordered
by commonness. Sets with equal beginnings are added up before anything is joined:
the more common a value, the fewer beginnings there are in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sets(rows: DataFrame, values: str) -> DataFrame:
    """(set, n): every different non-empty set of values and its rows."""
    members = F.array_sort(F.array_distinct(F.array_compact(values)))
    return rows.select(members.alias("set")).filter(F.size("set") > 0).groupBy("set").agg(F.count(F.lit(1)).alias("n"))


def _beginnings(sets: DataFrame, common: DataFrame) -> DataFrame:
    """(set, n, value, before): each value of a set that `common` knows, with the more common ones before it."""
    known = sets.select("set", "n", F.explode("set").alias("value")).join(common, "value")
    ordered = known.groupBy("set", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("rows"), "value"))), lambda s: s["value"]).alias("order"))
    return ordered.select("set", "n", "order", F.posexplode("order").alias("at", "value")).select("set", "n", "value", F.slice("order", F.lit(1), F.col("at")).alias("before"))


def overlap_counts(left: DataFrame, left_values: str, right: DataFrame, right_values: str, name: str) -> DataFrame:
    """`right` with column `name`: the rows of `left` that share at least one value with each of its rows.

    Both columns are arrays; nulls, nulls inside them and repeated values count for nothing.
    """
    people = _sets(left, left_values)
    common = people.select("n", F.explode("set").alias("value")).groupBy("value").agg(F.sum("n").alias("rows"))
    counted = _beginnings(people, common).groupBy("value", "before").agg(F.sum("n").alias("n"))
    asked = _beginnings(_sets(right, right_values), common).select("set", "value", F.col("before").alias("ahead"))
    met = asked.select("value", "ahead").distinct().join(counted, "value").filter(~F.arrays_overlap("ahead", "before"))
    owned = met.groupBy("value", "ahead").agg(F.sum("n").alias("n"))
    totals = asked.join(owned, ["value", "ahead"]).groupBy("set").agg(F.sum("n").alias(name))
    mine = F.array_sort(F.array_distinct(F.array_compact(right_values)))
    return right.withColumn("set", mine).join(totals, "set", "left").select(*right.columns, F.coalesce(name, F.lit(0)).alias(name))
