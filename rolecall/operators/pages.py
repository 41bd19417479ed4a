"""Joined rows behind the job, company and candidate pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.operators.filters import asks_between, is_active
from rolecall.operators.sort import order_by


def with_counts(jobs: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Adds one count column per log, counted before the join so a hot job stays one row."""
    for name, log in logs.items():
        counts = log.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
        jobs = jobs.join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return jobs


def application_detail(applications: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    listed = jobs.select(F.col("id").alias("job_id"), "title", "status", "company_id")
    brand = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return (
        applications.join(listed, "job_id")
        .join(brand, "company_id")
        .select("user_id", "job_id", "stage", "title", "status", "company_name")
    )


def company_jobs(jobs: DataFrame, sort: str = "recommended", k: int = 200) -> DataFrame:
    """Each company's first `k` active jobs in the given order."""
    ranked = Window.partitionBy("company_id").orderBy(*order_by(sort))
    return jobs.filter(is_active()).withColumn("pos", F.row_number().over(ranked)).filter(F.col("pos") <= k)


def in_buckets(asks: DataFrame, buckets: dict[str, tuple[int, int | None]]) -> DataFrame:
    """One row per (ask, bucket it overlaps); the bucket table is a literal array, so no join runs."""
    rows = [F.struct(F.lit(b).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi"))
            for b, (lo, hi) in buckets.items()]
    matching = F.filter(F.array(*rows), lambda b: asks_between(b["lo"], b["hi"]))
    return asks.withColumn("_bucket", F.explode(matching)).withColumn("bucket", F.col("_bucket.bucket")).drop("_bucket")


def recruiter_jobs(jobs: DataFrame, clicks: DataFrame, applications: DataFrame, k: int = 200) -> DataFrame:
    """Each recruiter's newest listings with the two counts they can act on."""
    newest = Window.partitionBy("posted_by_id").orderBy(F.desc("created_at"), F.desc("id"))
    own = jobs.filter(F.col("posted_by_id").isNotNull()).withColumn("pos", F.row_number().over(newest))
    return with_counts(own.filter(F.col("pos") <= k), {"apply_clicks": clicks, "applications": applications})


def candidate_applications(applications: DataFrame, k: int = 100) -> DataFrame:
    latest = Window.partitionBy("user_id").orderBy(F.desc("last_clicked_at"), F.desc("job_id"))
    return applications.withColumn("pos", F.row_number().over(latest)).filter(F.col("pos") <= k)


def saved_ids(saved: DataFrame) -> DataFrame:
    """Newest first per user: rows of a user share a partition and are sorted inside it, without a global order."""
    dealt = saved.select("user_id", "job_id", "created_at").repartition("user_id")
    return dealt.sortWithinPartitions("user_id", F.desc("created_at"), F.desc("job_id"))


def review_queues(claims: DataFrame, jobs: DataFrame, reviews: DataFrame, k: int = 50) -> DataFrame:
    """The oldest pending items of each queue. Inputs carry `key`, `status`, `created_at`."""

    def oldest(df: DataFrame, queue: str) -> DataFrame:
        waiting = df.filter(F.col("status") == "PENDING").orderBy("created_at", F.desc("key")).limit(k)
        return waiting.select(F.lit(queue).alias("queue"), "key", "created_at")

    return oldest(claims, "claim").unionByName(oldest(jobs, "job")).unionByName(oldest(reviews, "review"))


def sync_order(companies: DataFrame) -> DataFrame:
    """Least recently attempted first, never attempted before all."""
    return companies.orderBy(F.col("last_sync_attempt_at").asc_nulls_first(), F.lower("name"), "name", "id")


def claimable(companies: DataFrame, k: int = 1000) -> DataFrame:
    return companies.select("id", "name").orderBy(F.lower("name"), "name", "id").limit(k)


def company_logos(companies: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds `logo`: the stored URL, else the file a manifest row (`slug`) stands for, else null."""
    known = manifest.select("slug", F.concat(F.lit("/logos/"), "slug", F.lit(".webp")).alias("_file")).dropDuplicates(["slug"])
    stored = F.when(F.col("logo_url") != "", F.col("logo_url"))
    return companies.join(known, "slug", "left").withColumn("logo", F.coalesce(stored, "_file")).drop("_file")
