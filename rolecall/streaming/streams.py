"""The activity log and the feed snapshots as Structured Streaming jobs.

Column work is in plain functions that take a stream or a table alike. Jobs
that change a table do it in `foreachBatch`, one version of a bucketed table per
batch id: only the buckets that a batch touches are rewritten, and a batch that
runs twice writes the same version twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rolecall.functions.display_text import country_code, safe_referrer
from rolecall.operators.filters import is_active
from rolecall.plans import sync
from rolecall.session import cut_lineage
from rolecall.sources.buckets import FIRST, BucketTable, changed_by
from rolecall.sources.tables import upsert

ID_PATTERN = r"(?i)^[a-z0-9]{10,40}$"


def read_events(spark: SparkSession, folder: str, schema: str, files: str) -> DataFrame:
    """A file stream. Event time without a zone is taken as UTC, which watermarks need."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


# ------------------------------------------------------------------ clicks

def anonymous_clicks(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Clicks to log from apply requests (job_id, referrer, country_code, created_at): only for
    active jobs, referrer cut to host and path."""
    active = jobs.filter(is_active()).select(F.col("id").alias("job_id"))
    sound = requests.filter(F.col("job_id").rlike(ID_PATTERN)).join(active, "job_id", "left_semi")
    return sound.select(
        "job_id",
        safe_referrer(F.col("referrer")).alias("referrer"),
        country_code(F.col("country_code")).alias("country_code"),
        "created_at",
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def daily_clicks(clicks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Clicks per job and day; a day is final once the watermark has passed it."""
    return (
        clicks.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 day").alias("w"), "job_id")
        .agg(F.count(F.lit(1)).alias("clicks"))
        .select(F.col("w.start").alias("day"), "job_id", "clicks")
    )


def recent_clicks(daily: DataFrame, as_of: Column, days: list[int]) -> DataFrame:
    """Sums of whole days before `as_of`, one column per length."""
    sums = [
        F.sum(F.when(F.col("day") >= as_of - F.expr(f"INTERVAL '{n}' DAY"), F.col("clicks")).otherwise(0)).alias(f"clicks_{n}d")
        for n in days
    ]
    return daily.filter(F.col("day") < as_of).groupBy("job_id").agg(*sums)


def rate_flags(requests: DataFrame, client: str, limit: int, window: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """Clients over the limit per sliding window. Windows of one client are separate keys."""
    return (
        requests.withWatermark("ts", window)
        .groupBy(F.window("ts", window, slide).alias("w"), F.col(client).alias("client"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select(F.col("w.start").alias("start"), "client", "requests")
    )


# ------------------------------------------------------------------ tables

def latest_version(table: BucketTable, query: StreamingQuery) -> DataFrame:
    """The table after the last finished batch."""
    progress = query.lastProgress
    return table.rows(FIRST if progress is None else progress["batchId"])


def upsert_applications(stored: DataFrame, clicks: DataFrame) -> DataFrame:
    """First click on a job creates the application, later ones move last_clicked_at forward;
    a late or repeated event never moves it back."""
    pairs = clicks.groupBy("user_id", "job_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_clicked_at")
    )
    return upsert(
        stored,
        pairs,
        ["user_id", "job_id"],
        update={
            "created_at": F.least("t.created_at", "s.created_at"),
            "last_clicked_at": F.greatest("t.last_clicked_at", "s.last_clicked_at"),
        },
        insert={"stage": F.lit("APPLIED")},
    )


def applications_table(stored: DataFrame, path: str) -> BucketTable:
    table = BucketTable(stored.sparkSession, path, stored.schema, ("user_id", "job_id"))
    table.start(stored)
    return table


def stream_applications(clicks: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """Every batch rewrites the buckets of the pairs it names."""
    return (
        clicks.writeStream.foreachBatch(changed_by(table, upsert_applications))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FEED = ("company_id", "source")


class SyncTables(NamedTuple):
    """What a streamed sync keeps, all in buckets of feeds."""

    jobs: BucketTable
    waiting: BucketTable  # rows of runs that have not landed whole, with run_id
    done: BucketTable  # per feed the last run that was applied


def sync_tables(stored: DataFrame, snapshots: DataFrame, path: str) -> SyncTables:
    spark = stored.sparkSession
    kinds = {"jobs": stored.schema, "waiting": snapshots.schema, "done": snapshots.select(*FEED, "run_id").schema}
    tables = SyncTables(*[BucketTable(spark, f"{path}/{name}", schema, FEED) for name, schema in kinds.items()])
    tables.jobs.start(stored)
    for table in tables[1:]:
        table.start(spark.createDataFrame([], table.schema))
    return tables


def whole_runs(landed: DataFrame, runs: DataFrame, done: DataFrame) -> DataFrame:
    """run_id, run_at, company_id, source of the feeds' runs that can be applied: whole, and no earlier one still to land."""
    there = landed.groupBy("run_id", *FEED).agg(F.count(F.lit(1)).alias("_rows"))
    last = done.select(*FEED, F.col("run_id").alias("_last"))
    awaited = runs.filter("ok AND fetched > 0").join(landed.select(*FEED).distinct(), list(FEED), "left_semi").join(last, list(FEED), "left")
    met = awaited.filter("run_id > coalesce(_last, -1)").join(there, ["run_id", *FEED], "left").withColumn("_short", F.coalesce("_rows", F.lit(0)) < F.col("fetched"))
    blocked = met.filter("_short").groupBy(*FEED).agg(F.min("run_id").alias("_blocked"))
    return met.join(blocked, list(FEED), "left").filter("NOT _short AND (_blocked IS NULL OR run_id < _blocked)").select("run_id", "run_at", *FEED)


def stream_sync(snapshots: DataFrame, runs: DataFrame, tables: SyncTables, checkpoint: str) -> StreamingQuery:
    """Landed listings, diffed against the table feed by feed.

    `snapshots`: listings with run_id, in any number of files and batches per run.
    `runs`: one row per run and feed: run_id, company_id, source, ok, error, fetched, run_at.
    A feed's rows wait until its run is whole, so a run that arrives in parts
    expires nothing early. The runs of a feed are applied in order of run_id, each at
    its own time: a whole run waits for earlier ones that `runs` says are read (a run
    that will never land is to be marked not ok there), so the order in which rows
    land never matters. Rows of a run that is not ok go with the next one applied. A
    batch reads and rewrites the buckets of its feeds: waiting rows and last runs,
    and listings only where a run is whole.
    """
    columns = tables.jobs.schema.names

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = batch_id - 1
        touched = tables.jobs.touched(batch)
        landed = tables.waiting.rows(before, touched).unionByName(batch)
        done = tables.done.rows(before, touched)
        ready = cut_lineage(whole_runs(landed, runs, done))
        # The bucket and run of every whole feed run: as many rows as the touched buckets have runs to apply.
        applied = ready.select(tables.jobs.bucket().alias("bucket"), "run_id", "run_at").distinct().collect()
        changed = sorted({r["bucket"] for r in applied})
        listings = tables.jobs.rows(before, changed)
        for run_id, run_at in sorted({(r["run_id"], r["run_at"]) for r in applied}):
            whole = ready.filter(F.col("run_id") == run_id).select(*FEED)
            rows = landed.filter(F.col("run_id") == run_id).drop("run_id").join(whole, list(FEED), "left_semi")
            feeds = runs.filter(F.col("run_id") == run_id).drop("run_id", "run_at").join(whole, list(FEED), "left_semi")
            listings = sync.apply_sync(sync.plan_sync(listings, rows, feeds), listings, rows, F.lit(run_at), columns)
        tables.jobs.change(batch_id, changed, listings)
        newest = done.unionByName(ready.select(*tables.done.schema.names)).groupBy(*FEED).agg(F.max("run_id").alias("run_id"))
        tables.done.change(batch_id, touched, newest)
        last = newest.withColumnRenamed("run_id", "_last")
        open_rows = landed.join(last, list(FEED), "left").filter("run_id > coalesce(_last, -1)").select(*tables.waiting.schema.names)
        tables.waiting.change(batch_id, touched, open_rows)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def funnel(clicks: DataFrame, applications: DataFrame, changes: DataFrame) -> DataFrame:
    """(step, n): clicks, applications, and applications by their latest stage.

    `changes`: user_id, job_id, stage, stage_updated_at; the last one of a pair counts.
    """
    last = changes.groupBy("user_id", "job_id").agg(F.max_by("stage", F.struct("stage_updated_at", "stage")).alias("_stage"))
    staged = applications.join(last, ["user_id", "job_id"], "left").select(F.coalesce("_stage", "stage").alias("step"))
    every = F.count(F.lit(1)).alias("n")
    return (
        clicks.agg(every)
        .select(F.lit("click").alias("step"), "n")
        .unionByName(applications.agg(every).select(F.lit("application").alias("step"), "n"))
        .unionByName(staged.groupBy("step").agg(every))
    )
