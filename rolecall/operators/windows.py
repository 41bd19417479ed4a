"""Per-group ranking, latest-wins and rolling-count operators.

Rankings keep the first k rows, which Spark also limits before the shuffle, so
a hot group sends k rows per task. Latest-wins is an aggregate, not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.operators.filters import is_active
from rolecall.session import cut_lineage


def similar_jobs(jobs: DataFrame, k: int = 4) -> DataFrame:
    """For every job, `k` other active ones of its discipline: pay published first, then newest.

    Only the first k + 1 of a discipline can ever be shown, and there are six
    disciplines, so the shortlist is a few dozen rows whatever the table holds.
    """
    best = Window.partitionBy("discipline").orderBy(F.desc("salary_disclosed"), F.desc("posted_at"), F.desc("id"))
    shortlist = (
        jobs.filter(is_active())
        .select("discipline", "id", "salary_disclosed", "posted_at")
        .withColumn("r", F.row_number().over(best))
        .filter(F.col("r") <= k + 1)
        .groupBy("discipline")
        .agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("best"))
    )
    others = F.slice(F.filter(F.transform("best", lambda b: b["id"]), lambda i: i != F.col("id")), 1, k)
    return (
        jobs.select("id", "discipline")
        .join(F.broadcast(shortlist), "discipline")
        .select("id", F.posexplode(others).alias("p", "similar_id"))
        .select("id", (F.col("p") + 1).alias("pos"), "similar_id")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order`, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def current_membership(members: DataFrame) -> DataFrame:
    """Per user: an approved company if there is one, else the newest open or refused claim."""
    approved = F.col("status") == "APPROVED"
    return latest(members, ["user_id"], [approved, F.col("created_at"), F.col("company_id")])


def rolling_requests(
    requests: DataFrame, client: str, at: Column, limit: int, window_seconds: int = 60
) -> DataFrame:
    """Requests of each client in the window ending at each second, and whether that is over the limit.

    Requests are counted per second first. Each count then goes to its own time
    slice and to the next one as context, so a busy client is spread over slices
    and no slice holds more than two windows of seconds.
    """
    seconds = (
        requests.select(F.col(client).alias("client"), at.cast("timestamp").cast("long").alias("second"))
        .groupBy("client", "second")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    own = F.floor(F.col("second") / window_seconds)
    sliced = seconds.select("*", F.explode(F.array(own, own + 1)).alias("slice"), own.alias("own"))
    back = Window.partitionBy("client", "slice").orderBy("second").rangeBetween(-(window_seconds - 1), 0)
    counted = sliced.withColumn("in_window", F.sum("requests").over(back)).filter(F.col("slice") == F.col("own"))
    return counted.select("client", "second", "requests", "in_window", (F.col("in_window") > limit).alias("over_limit"))


def number_rows(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`rows` with column `name`: their place, from 0, in the group of `by` (never null) when it is sorted by `order`.

    What row_number gives, without a group in one task: rows are dealt by ranges of
    (by, order), counted per range, and the counts of earlier ranges are added up.
    Rows alike in all of it are dealt by their origin.
    """
    keys = [*by, *order, "_origin"]
    dealt = rows.withColumn("_origin", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    sorted_rows = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_origin")
    placed = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(ranges, [*by, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
