"""Counts, percentiles and top lists over the job board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.enums import CURRENCY_ORDER, DISCIPLINE_ORDER, LEVEL_ORDER, ordinal
from rolecall.operators.filters import is_active
from rolecall.operators.percentiles import exact_percentiles

# The shortcut cities of the home page.
HOME_CITIES = ["Bengaluru", "Hyderabad", "Pune", "Gurugram", "Chennai", "Mumbai", "Noida", "Delhi"]

# Percentile histogram step, in rupees. Bands end at 200 million, so a group has
# at most 4,000 buckets and a bucket at most 100,000 distinct midpoints.
SALARY_STEP = 50_000


def round_half_up(column: Column) -> Column:
    return F.floor(column + 0.5)


def salary_stats(jobs: DataFrame) -> DataFrame:
    """Band midpoints of active INR roles: count and quartiles per discipline, level and currency."""
    middle = (F.col("salary_min").cast("long") + F.col("salary_max").cast("long")) / F.lit(2.0)
    paid = jobs.filter(is_active() & F.col("salary_disclosed") & (F.col("currency") == "INR"))
    keys = ["discipline", "level", "currency"]
    stats = exact_percentiles(paid, keys, middle, {"p25": 0.25, "median": 0.5, "p75": 0.75}, SALARY_STEP)
    return (
        stats.filter(F.col("n") >= 2)
        .orderBy(
            ordinal(DISCIPLINE_ORDER, F.col("discipline")),
            ordinal(LEVEL_ORDER, F.col("level")),
            ordinal(CURRENCY_ORDER, F.col("currency")),
        )
        .select(*keys, F.col("n").alias("roles"), *[round_half_up(F.col(c)).alias(c) for c in ("p25", "median", "p75")])
    )


def home_counts(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_active()).agg(
        F.count(F.lit(1)).alias("total_active"),
        F.count_if("salary_disclosed").alias("with_salary"),
        F.count_if(F.col("remote") == "REMOTE").alias("remote_count"),
    )


def by_discipline(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_active()).groupBy("discipline").agg(F.count(F.lit(1)).alias("n"))


def city_counts(jobs: DataFrame, cities: list[str] = HOME_CITIES) -> DataFrame:
    """A job counts once for every listed city its location names."""
    named = F.array_compact(F.array(*[F.when(F.col("location").contains(c), F.lit(c)) for c in cities]))
    return (
        jobs.filter(is_active())
        .select(F.explode(named).alias("city"))
        .groupBy("city")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "city")
    )


def _role_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("all_roles"), F.count_if(is_active()).alias("open_roles")
    )


def hiring_companies(jobs: DataFrame, companies: DataFrame, k: int = 12, order_by: str = "all") -> DataFrame:
    """Companies with an open role. The default order counts every stored role, as the list
    always has; `order_by="active"` orders by the number shown."""
    counts = _role_counts(jobs).filter(F.col("open_roles") > 0)
    rank = "all_roles" if order_by == "all" else "open_roles"
    top = counts.orderBy(F.desc(rank), F.desc("company_id")).limit(k)
    return (
        top.join(companies, F.col("id") == F.col("company_id"))
        .orderBy(F.desc(rank), F.desc("company_id"))
        .select("company_id", "name", "slug", "open_roles")
    )


def company_directory(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    counts = jobs.filter(is_active()).groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("open_roles"))
    return (
        companies.join(counts, "id")
        .orderBy(F.desc("open_roles"), F.lower("name"), "name", "id")
        .select("id", "slug", "name", "open_roles")
    )


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_up(part * F.lit(100.0) / whole).cast("long"))


def top_clicked(
    jobs: DataFrame, clicks: DataFrame, as_of: Column, days: int = 30, k: int = 10, order_by: str = "all"
) -> DataFrame:
    """Jobs clicked in the window. The default order counts all-time clicks; the count shown is recent."""
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY")
    counts = (
        clicks.groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("all_clicks"), F.count_if(recent).alias("recent_clicks"))
        .filter(F.col("recent_clicks") > 0)
    )
    rank = "all_clicks" if order_by == "all" else "recent_clicks"
    return (
        counts.join(jobs.select("id", "title"), F.col("id") == F.col("job_id"))
        .orderBy(F.desc(rank), F.desc("id"))
        .limit(k)
        .select("id", "title", "recent_clicks")
    )


def stage_counts(applications: DataFrame) -> DataFrame:
    return applications.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """Approved reviews only; the mean keeps one decimal."""
    mean = F.floor(F.avg("rating") * 10 + 0.5) / 10
    return (
        reviews.filter(F.col("status") == "APPROVED")
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias("reviews"), mean.alias("average"))
    )


def latest_reviews(reviews: DataFrame, k: int = 20) -> DataFrame:
    newest = Window.partitionBy("company_id").orderBy(F.desc("created_at"), F.desc("user_id"))
    return (
        reviews.filter(F.col("status") == "APPROVED").withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= k)
    )


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One pass over a table, one (metric, value) row per named aggregate."""
    counted = df.agg(*[c.cast("long").alias(name) for name, c in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])
    return counted.select(F.inline(pairs))


def operator_metrics(
    jobs: DataFrame,
    companies: DataFrame,
    clicks: DataFrame,
    users: DataFrame,
    profiles: DataFrame,
    saved: DataFrame,
    applications: DataFrame,
    members: DataFrame,
    reviews: DataFrame,
    as_of: Column,
) -> DataFrame:
    """The operator dashboard's scalar counts as (metric, value) rows."""
    every = F.count(F.lit(1))
    week = as_of - F.expr("INTERVAL '7' DAY")
    hiring = jobs.filter(is_active()).select("company_id").distinct()
    parts = [
        metric_rows(users, {"users": every, "new_users_7d": F.count_if(F.col("created_at") >= week),
                            "recruiters": F.count_if(F.col("role") == "RECRUITER")}),
        metric_rows(profiles, {"profiles": every, "with_resume": F.count("resume_key")}),
        metric_rows(saved, {"saved_jobs": every}),
        metric_rows(applications, {"applications": every,
                                   "applications_7d": F.count_if(F.col("created_at") >= week)}),
        metric_rows(jobs, {"active_jobs": F.count_if(is_active()),
                           "closed_jobs": F.count_if(F.col("status").isin("CLOSED", "EXPIRED")),
                           "with_salary": F.count_if(is_active() & F.col("salary_disclosed")),
                           "pending_jobs": F.count_if(F.col("status") == "PENDING")}),
        metric_rows(hiring, {"hiring_companies": every}),
        metric_rows(companies, {"companies": every}),
        metric_rows(clicks, {"clicks": every, "clicks_7d": F.count_if(F.col("created_at") >= week)}),
        metric_rows(members, {"pending_claims": F.count_if(F.col("status") == "PENDING")}),
        metric_rows(reviews, {"pending_reviews": F.count_if(F.col("status") == "PENDING"),
                              "approved_reviews": F.count_if(F.col("status") == "APPROVED")}),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    waiting = rows.filter(F.col("metric").startswith("pending_")).agg(F.sum("value").alias("value"))
    return rows.unionByName(waiting.select(F.lit("waiting").alias("metric"), "value"))


def feed_health(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per company: sync state and open roles, by name."""
    counts = jobs.filter(is_active()).groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).alias("active_roles"))
    return companies.join(counts, "id", "left").select(
        *companies.columns, F.coalesce("active_roles", F.lit(0)).alias("active_roles")
    )
