"""Snapshot changes to stored tables.

Plain Parquet has no row-level update, so a change is a new snapshot: a function
takes the stored table and the change and returns the next version. `publish`
writes it beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.operators.windows import latest


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is not stored yet, one per key, appended to the target."""
    fresh = new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column], insert: dict[str, Column] | None = None
) -> DataFrame:
    """Next version of `target`: `update` columns on a matched key, `insert` values on a new one.

    Columns of the source are addressed as `s.<name>`, stored ones as `t.<name>`.
    The source must hold one row per key.
    """
    t = target.withColumn("_stored", F.lit(True)).alias("t")
    s = source.withColumn("_sent", F.lit(True)).alias("s")
    on = None
    for key in keys:
        same = F.col(f"t.{key}") == F.col(f"s.{key}")
        on = same if on is None else on & same
    both = F.col("t._stored") & F.col("s._sent")
    only_new = F.col("t._stored").isNull()
    insert = insert or {}
    columns = []
    for name in target.columns:
        stored = F.col(f"t.{name}")
        if name in keys:
            columns.append(F.coalesce(stored, F.col(f"s.{name}")).alias(name))
            continue
        created = insert.get(name)
        if created is None:
            created = F.col(f"s.{name}") if name in source.columns else F.lit(None)
        changed = update.get(name, stored)
        columns.append(F.when(only_new, created).when(both, changed).otherwise(stored).alias(name))
    return t.join(s, on, "full_outer").select(*columns)


def seed_companies(companies: DataFrame, seed: DataFrame) -> DataFrame:
    """Adds starting companies that are missing; an existing slug is never overwritten."""
    return insert_missing(companies, seed, ["slug"])


def cascade_delete(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Removes users and the rows keyed by them. Clicks are anonymous and stay; jobs stay
    without their poster."""
    gone = users.select("user_id").distinct()
    result = {}
    for name, df in tables.items():
        if name == "user":
            result[name] = df.join(gone.select(F.col("user_id").alias("id")), "id", "left_anti")
        elif name == "job":
            marked = gone.select(F.col("user_id").alias("posted_by_id"), F.lit(True).alias("_gone"))
            kept = F.when(F.col("_gone").isNull(), F.col("posted_by_id")).alias("posted_by_id")
            # Most jobs have no poster: they skip the join, where null would be one hot key.
            joined = df.filter(F.col("posted_by_id").isNotNull()).join(marked, "posted_by_id", "left")
            changed = joined.select(*[kept if c == "posted_by_id" else F.col(c) for c in df.columns])
            result[name] = df.filter(F.col("posted_by_id").isNull()).unionByName(changed)
        elif "user_id" in df.columns and name != "apply_click":
            result[name] = df.join(gone, "user_id", "left_anti")
        else:
            result[name] = df
    return result


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Repeated keys in a feed: the last one read wins."""
    return latest(df, keys, [F.col(position)])


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Write a snapshot. Sorting inside files lets readers skip row groups by min/max."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
