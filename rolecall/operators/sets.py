"""Set operations: skill unions, saved lists, keyword sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions.text import bind
from rolecall.operators.windows import latest


def distinct_ignoring_case(values: Column) -> Column:
    """First spelling of each value, in order; blanks dropped."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.length(v) > 0)

    # Bound: named inside the filter, the list and all it is made of would be worked out anew for each value.
    def first(seen: Column) -> Column:
        return F.filter(seen["kept"], lambda v, i: F.array_position(seen["folded"], F.lower(v)) == i + 1)

    return bind(bind(kept, lambda k: F.struct(k.alias("kept"), F.transform(k, F.lower).alias("folded"))), first)


def union_skills(first: Column, second: Column) -> Column:
    empty = F.array().cast("array<string>")
    return distinct_ignoring_case(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def newest_saved(saved: DataFrame, limit: int | None = None) -> DataFrame:
    """Per user, the saved ids as an array, newest first: all, or the first `limit`."""
    kept = saved
    if limit is not None:
        order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("job_id"))
        kept = saved.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("created_at", "job_id")), asc=False), lambda s: s["job_id"])
    return kept.groupBy("user_id").agg(ordered.alias("server_ids"))


def reconcile_saves(browsers: DataFrame, saved: DataFrame) -> DataFrame:
    """What each browser's saved list becomes.

    `browsers`: browser_id, user_id (null when signed out), owner (null for an
    anonymous list), ids. An anonymous list merges into the account once; an
    owned list gives way to the account; signing out clears an owned list.
    """
    empty = F.array().cast("array<string>")
    server = F.coalesce("server_ids", empty)
    joined = browsers.join(newest_saved(saved), "user_id", "left")
    signed_in, anonymous = F.col("user_id").isNotNull(), F.col("owner").isNull()
    merged = F.concat("ids", F.filter(server, lambda i: ~F.array_contains("ids", i)))
    return joined.select(
        "browser_id",
        F.when(signed_in & anonymous, merged)
        .when(signed_in, server)
        .when(anonymous, F.col("ids"))
        .otherwise(empty)
        .alias("ids"),
        F.col("user_id").alias("owner"),
        F.when(signed_in & anonymous, F.col("ids")).otherwise(empty).alias("to_upload"),
    )


def apply_saves(saved: DataFrame, requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Saved pairs after a batch of (user_id, job_id, action, asked_at); repeats are harmless.

    The last action on a pair counts; saving an unknown job is skipped.
    """
    last = latest(requests.select("user_id", "job_id", "action", "asked_at"), ["user_id", "job_id"], [F.col("asked_at"), F.col("action")])
    known = jobs.select(F.col("id").alias("job_id"))
    added = last.filter(F.col("action") == "save").join(known, "job_id", "left_semi")
    removed = last.filter(F.col("action") == "unsave")
    pairs = ["user_id", "job_id"]
    fresh = added.join(saved.select(*pairs), pairs, "left_anti").select(*pairs, F.col("asked_at").alias("created_at"))
    return saved.join(removed.select(*pairs), pairs, "left_anti").unionByName(fresh)
