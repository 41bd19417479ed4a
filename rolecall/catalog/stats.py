"""Registered queries: aggregates (A operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.operators import stats
from rolecall.plans.views import AS_OF



@query(
    "A1_salary_stats",
    """SELECT discipline, level, currency, count(*) AS roles,
 CAST(floor(quantile_cont((salary_min + salary_max) / 2.0, 0.25) + 0.5) AS BIGINT) AS p25,
 CAST(floor(quantile_cont((salary_min + salary_max) / 2.0, 0.5) + 0.5) AS BIGINT) AS median,
 CAST(floor(quantile_cont((salary_min + salary_max) / 2.0, 0.75) + 0.5) AS BIGINT) AS p75
 FROM v_job WHERE status = 'ACTIVE' AND salary_disclosed AND currency = 'INR'
 GROUP BY discipline, level, currency HAVING count(*) >= 2""",
)
def salary(t):
    return stats.salary_stats(t.v_job)


@query(
    "A2_home_counts",
    """SELECT count(*) AS total_active, count(*) FILTER (WHERE salary_disclosed) AS with_salary,
 count(*) FILTER (WHERE remote = 'REMOTE') AS remote_count FROM v_job WHERE status = 'ACTIVE'""",
)
def home(t):
    return stats.home_counts(t.v_job)


@query("A3_by_discipline", "SELECT discipline, count(*) AS n FROM v_job WHERE status = 'ACTIVE' GROUP BY discipline")
def disciplines(t):
    return stats.by_discipline(t.v_job)


@query(
    "A4_city_counts",
    """SELECT c.city, count(*) AS n FROM v_job j JOIN (SELECT * FROM (VALUES ('NATION_1'), ('NATION_2'), ('NATION_20'),
 ('NATION_7'), ('nowhere')) v(city)) c ON contains(j.location, c.city) WHERE j.status = 'ACTIVE' GROUP BY c.city""",
)
def cities(t):
    return stats.city_counts(t.v_job, ["NATION_1", "NATION_2", "NATION_20", "NATION_7", "nowhere"])


@query(
    "A5_hiring_companies",
    """WITH n AS (SELECT company_id, count(*) AS every, count(*) FILTER (WHERE status = 'ACTIVE') AS open_roles
 FROM v_job GROUP BY company_id)
 SELECT n.company_id, c.name, c.slug, n.open_roles FROM n JOIN v_company c ON c.id = n.company_id
 WHERE n.open_roles > 0 ORDER BY n.every DESC, n.company_id DESC LIMIT 12""",
)
def hiring(t):
    return stats.hiring_companies(t.v_job, t.v_company)


@query(
    "A6_company_directory",
    """SELECT c.id, c.slug, c.name, count(*) AS open_roles FROM v_company c JOIN v_job j ON j.company_id = c.id
 WHERE j.status = 'ACTIVE' GROUP BY c.id, c.slug, c.name""",
)
def directory(t):
    return stats.company_directory(t.v_job, t.v_company)


_USERS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'RECRUITER' ELSE 'SEEKER' END AS role,
 TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 30) * INTERVAL '1' DAY AS created_at FROM customer"""
_PROFILES = "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN city END AS resume_key FROM v_candidate"


@query(
    "A7_operator_metrics",
    f"""WITH u AS ({_USERS}), p AS ({_PROFILES}), m AS (
 SELECT 'users' AS metric, count(*) AS value FROM u
 UNION ALL SELECT 'new_users_7d', count(*) FROM u WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
 UNION ALL SELECT 'recruiters', count(*) FROM u WHERE role = 'RECRUITER'
 UNION ALL SELECT 'profiles', count(*) FROM p
 UNION ALL SELECT 'with_resume', count(resume_key) FROM p
 UNION ALL SELECT 'saved_jobs', count(*) FROM v_saved
 UNION ALL SELECT 'applications', count(*) FROM v_application
 UNION ALL SELECT 'applications_7d', count(*) FROM v_application WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
 UNION ALL SELECT 'active_jobs', count(*) FROM v_job WHERE status = 'ACTIVE'
 UNION ALL SELECT 'closed_jobs', count(*) FROM v_job WHERE status IN ('CLOSED', 'EXPIRED')
 UNION ALL SELECT 'with_salary', count(*) FROM v_job WHERE status = 'ACTIVE' AND salary_disclosed
 UNION ALL SELECT 'pending_jobs', count(*) FROM v_job WHERE status = 'PENDING'
 UNION ALL SELECT 'hiring_companies', count(DISTINCT company_id) FROM v_job WHERE status = 'ACTIVE'
 UNION ALL SELECT 'companies', count(*) FROM v_company
 UNION ALL SELECT 'clicks', count(*) FROM v_click
 UNION ALL SELECT 'clicks_7d', count(*) FROM v_click WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
 UNION ALL SELECT 'pending_claims', count(*) FROM v_member WHERE status = 'PENDING'
 UNION ALL SELECT 'pending_reviews', count(*) FROM v_review WHERE status = 'PENDING'
 UNION ALL SELECT 'approved_reviews', count(*) FROM v_review WHERE status = 'APPROVED')
 SELECT metric, value FROM m UNION ALL
 SELECT 'waiting', CAST(sum(value) AS BIGINT) FROM m WHERE metric LIKE 'pending\\_%' ESCAPE '\\'""",
)
def metrics(t):
    return stats.operator_metrics(
        t.v_job, t.v_company, t.v_click, t.sql(_USERS), t.sql(_PROFILES), t.v_saved, t.v_application,
        t.v_member, t.v_review, F.lit(AS_OF).cast("timestamp"),
    )


@query(
    "A8_share",
    """SELECT company_id, CASE WHEN count(*) FILTER (WHERE status = 'ACTIVE') > 0 THEN
 CAST(floor(count(*) FILTER (WHERE status = 'ACTIVE' AND salary_disclosed) * 100.0 / count(*) FILTER (WHERE status = 'ACTIVE') + 0.5)
 AS BIGINT) END AS paid_share FROM v_job GROUP BY company_id""",
)
def paid_share(t):
    open_now = F.col("status") == "ACTIVE"
    counted = t.v_job.groupBy("company_id").agg(
        F.count_if(open_now & F.col("salary_disclosed")).alias("a"), F.count_if(open_now).alias("b")
    )
    return counted.select("company_id", stats.share(F.col("a"), F.col("b")).alias("paid_share"))


@query(
    "A9_top_clicked",
    f"""WITH n AS (SELECT job_id, count(*) AS every,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY) AS recent FROM v_click GROUP BY job_id)
 SELECT j.id, j.title, n.recent AS recent_clicks FROM n JOIN v_job j ON j.id = n.job_id WHERE n.recent > 0
 ORDER BY n.every DESC, j.id DESC LIMIT 10""",
)
def clicked(t):
    return stats.top_clicked(t.v_job, t.v_click, F.lit(AS_OF).cast("timestamp"))


@query("A10_stage_counts", "SELECT stage, count(*) AS n FROM v_application GROUP BY stage")
def stages(t):
    return stats.stage_counts(t.v_application)


@query(
    "A11_review_stats",
    """SELECT company_id, count(*) AS reviews, floor(avg(rating) * 10 + 0.5) / 10 AS average FROM v_review
 WHERE status = 'APPROVED' GROUP BY company_id""",
)
def reviews(t):
    return stats.review_stats(t.v_review)


@query(
    "A11_latest_reviews",
    """SELECT company_id, user_id, rating, pos FROM (SELECT *, row_number() OVER (PARTITION BY company_id
 ORDER BY created_at DESC, user_id DESC) AS pos FROM v_review WHERE status = 'APPROVED') x WHERE pos <= 20""",
)
def latest_reviews(t):
    return stats.latest_reviews(t.v_review).select("company_id", "user_id", "rating", "pos")


@query(
    "A15_feed_coverage",
    """SELECT count(*) FILTER (WHERE status = 'ACTIVE') AS live,
 count(DISTINCT CASE WHEN source <> 'MANUAL' THEN company_id END) AS feeds FROM v_job""",
)
def coverage(t):
    """Live total after a sync and the number of companies with a feed."""
    per_company = t.v_job.groupBy("company_id").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("live"), F.max((F.col("source") != "MANUAL").cast("int")).alias("fed")
    )
    return per_company.agg(F.sum("live").alias("live"), F.sum("fed").cast("long").alias("feeds"))


@query(
    "A16_feed_health",
    """SELECT c.id, c.name, max(j.last_verified_at) AS last_synced_at,
 count(*) FILTER (WHERE j.status = 'ACTIVE') AS active_roles FROM v_company c
 LEFT JOIN v_job j ON j.company_id = c.id GROUP BY c.id, c.name""",
)
def health(t):
    jobs = t.v_job
    synced = jobs.groupBy(F.col("company_id").alias("id")).agg(F.max("last_verified_at").alias("last_synced_at"))
    companies = t.v_company.select("id", "name").join(synced, "id", "left")
    return stats.feed_health(companies, jobs)
