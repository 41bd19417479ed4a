"""Registered queries: windows, lists per user, set operations and table changes (W, O, U, S operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.operators import pages, sets, windows
from rolecall.plans.views import AS_OF
from rolecall.sources import tables


@query(
    "W1_similar_jobs",
    """WITH best AS (SELECT discipline, id, row_number() OVER (PARTITION BY discipline
  ORDER BY salary_disclosed DESC, posted_at DESC, id DESC) AS r FROM v_job WHERE status = 'ACTIVE'),
 pairs AS (SELECT j.id, b.id AS similar_id, row_number() OVER (PARTITION BY j.id ORDER BY b.r) AS pos
  FROM v_job j JOIN best b ON b.discipline = j.discipline AND b.id <> j.id WHERE b.r <= 5)
 SELECT id, pos, similar_id FROM pairs WHERE pos <= 4""",
)
def similar(t):
    return windows.similar_jobs(t.v_job)


@query(
    "W7_current_membership",
    """SELECT user_id, company_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY status = 'APPROVED' DESC, created_at DESC, company_id DESC) AS r FROM v_member) x WHERE r = 1""",
)
def membership(t):
    return windows.current_membership(t.v_member).select("user_id", "company_id", "status")


@query(
    "W8_last_wins",
    """SELECT job_id, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS r
 FROM v_click) x WHERE r = 1""",
)
def last_wins(t):
    return tables.last_per_key(t.v_click, ["job_id"], "event_id").select("job_id", "event_id", "user_id")


@query(
    "W9_rolling_requests",
    """WITH s AS (SELECT user_id AS client, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS requests
  FROM events GROUP BY 1, 2)
 SELECT client, second, requests, w AS in_window, w > 2 AS over_limit FROM (SELECT *, CAST(sum(requests) OVER (
  PARTITION BY client ORDER BY second RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW) AS BIGINT) AS w FROM s) x""",
)
def rolling(t):
    return windows.rolling_requests(t.events, "user_id", F.col("ts"), limit=2, window_seconds=172_800)


# ------------------------------------------------------------------ lists

_ATTEMPTS = """SELECT id, name, CASE WHEN id % 7 = 0 THEN NULL
 ELSE TIMESTAMP '2024-01-20 00:00:00' + (id % 5) * INTERVAL '1' DAY END AS last_sync_attempt_at FROM v_company"""


@query("O8_sync_order", f"SELECT id, name FROM ({_ATTEMPTS}) x ORDER BY last_sync_attempt_at NULLS FIRST, lower(name), name, id")
def sync_order(t):
    return pages.sync_order(t.sql(_ATTEMPTS)).select("id", "name")


@query(
    "O9_review_queues",
    """SELECT * FROM (SELECT 'claim' AS queue, concat(CAST(user_id AS VARCHAR), '/', CAST(company_id AS VARCHAR)) AS key, created_at
  FROM v_member WHERE status = 'PENDING' ORDER BY created_at, key DESC LIMIT 50) a
 UNION ALL SELECT * FROM (SELECT 'job' AS queue, id AS key, posted_at AS created_at FROM v_job WHERE status = 'PENDING'
  ORDER BY created_at, key DESC LIMIT 50) b
 UNION ALL SELECT * FROM (SELECT 'review' AS queue, concat(CAST(user_id AS VARCHAR), '/', CAST(company_id AS VARCHAR)) AS key, created_at
  FROM v_review WHERE status = 'PENDING' ORDER BY created_at, key DESC LIMIT 50) c""",
)
def queues(t):
    pair = F.concat_ws("/", "user_id", "company_id").alias("key")
    claims = t.v_member.select(pair, "status", "created_at")
    jobs = t.v_job.select(F.col("id").alias("key"), "status", F.col("posted_at").alias("created_at"))
    reviews = t.v_review.select(pair, "status", F.col("created_at").cast("timestamp").alias("created_at"))
    return pages.review_queues(claims, jobs, reviews)


_POSTED = """SELECT id, title, company_id, status, CASE WHEN source = 'MANUAL' THEN company_id END AS posted_by_id,
 posted_at AS created_at FROM v_job"""


@query(
    "O10_recruiter_jobs",
    f"""SELECT j.posted_by_id, j.id, j.pos, coalesce(c.n, 0) AS apply_clicks, coalesce(a.n, 0) AS applications FROM (
 SELECT *, row_number() OVER (PARTITION BY posted_by_id ORDER BY created_at DESC, id DESC) AS pos FROM ({_POSTED}) p
 WHERE posted_by_id IS NOT NULL) j
 LEFT JOIN (SELECT job_id, count(*) AS n FROM v_click GROUP BY job_id) c ON c.job_id = j.id
 LEFT JOIN (SELECT job_id, count(*) AS n FROM v_application GROUP BY job_id) a ON a.job_id = j.id WHERE j.pos <= 200""",
)
def recruiter_jobs(t):
    found = pages.recruiter_jobs(t.sql(_POSTED), t.v_click, t.v_application)
    return found.select("posted_by_id", "id", "pos", "apply_clicks", "applications")


@query("O11_claimable", "SELECT id, name FROM v_company ORDER BY lower(name), name, id LIMIT 1000")
def claimable(t):
    return pages.claimable(t.v_company)


@query(
    "O12_candidate_applications",
    """SELECT user_id, job_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY last_clicked_at DESC, job_id DESC) AS pos FROM v_application) x WHERE pos <= 100""",
)
def applications(t):
    return pages.candidate_applications(t.v_application).select("user_id", "job_id", "pos")


@query("O13_saved_ids", "SELECT user_id, job_id, created_at FROM v_saved")
def saved_ids(t):
    return pages.saved_ids(t.v_saved)


# ------------------------------------------------------------------ sets


@query(
    "U1_union_boards",
    """SELECT external_id, max(board) AS board FROM (
 SELECT id AS external_id, 1 AS board FROM v_job WHERE source <> 'MANUAL'
 UNION ALL SELECT id, 2 FROM v_job WHERE source = 'LEVER' UNION ALL SELECT id, 3 FROM v_job WHERE featured) x GROUP BY external_id""",
)
def boards(t):
    """A company's boards read one after another; a posting on two of them counts once, last read wins."""
    jobs = t.v_job.select(F.col("id").alias("external_id"), "source", "featured")
    first = jobs.filter(F.col("source") != "MANUAL").select("external_id", F.lit(1).alias("board"))
    second = jobs.filter(F.col("source") == "LEVER").select("external_id", F.lit(2).alias("board"))
    third = jobs.filter("featured").select("external_id", F.lit(3).alias("board"))
    return tables.last_per_key(first.unionByName(second).unionByName(third).withColumn("n", F.col("board")), ["external_id"], "n").select(
        "external_id", "board"
    )


@query(
    "U3_union_skills",
    """WITH s AS (SELECT user_id, list_sort(list(DISTINCT skill)) AS skills FROM v_candidate_skill GROUP BY user_id)
 SELECT c.user_id, array_to_string(list_concat(coalesce(s.skills, []),
  list_filter(['Small', 'promo', 'Extra'], lambda x: NOT list_contains(coalesce(s.skills, []), upper(x)))), ',') AS skills
 FROM v_candidate c LEFT JOIN s ON s.user_id = c.user_id""",
)
def skills(t):
    more = F.array(*[F.lit(x) for x in ("Small", " promo ", "Extra", "SMALL", "")])
    return t.candidate.select("user_id", F.array_join(sets.union_skills(F.col("skills"), more), ",").alias("skills"))


_BROWSERS = """SELECT b.user_id AS browser_id, CASE WHEN b.user_id % 7 <> 0 THEN b.user_id END AS user_id,
 CASE b.user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN b.user_id ELSE b.user_id + 1 END AS owner, b.job_id, b.created_at FROM v_click b"""


@query(
    "U5_reconcile_saves",
    f"""WITH b AS (SELECT browser_id, user_id, owner, list_sort(list(DISTINCT job_id)) AS ids FROM ({_BROWSERS}) x
  GROUP BY browser_id, user_id, owner),
 s AS (SELECT user_id, list(job_id ORDER BY created_at DESC, job_id DESC)[1:100] AS server_ids FROM v_saved GROUP BY user_id),
 j AS (SELECT b.*, coalesce(s.server_ids, []) AS server_ids FROM b LEFT JOIN s ON s.user_id = b.user_id)
 SELECT browser_id, user_id AS owner,
  array_to_string(CASE WHEN user_id IS NOT NULL AND owner IS NULL
   THEN list_concat(ids, list_filter(server_ids, lambda x: NOT list_contains(ids, x)))[1:100]
   WHEN user_id IS NOT NULL THEN server_ids WHEN owner IS NULL THEN ids ELSE [] END, ',') AS ids,
  array_to_string(CASE WHEN user_id IS NOT NULL AND owner IS NULL THEN ids[1:100] ELSE [] END, ',') AS to_upload FROM j""",
)
def reconcile(t):
    browsers = t.sql(_BROWSERS).groupBy("browser_id", "user_id", "owner").agg(
        F.sort_array(F.collect_set("job_id")).alias("ids")
    )
    done = sets.reconcile_saves(browsers, t.v_saved)
    return done.select(
        "browser_id", "owner", F.array_join("ids", ",").alias("ids"), F.array_join("to_upload", ",").alias("to_upload")
    )


_REQUESTS = """SELECT user_id, ts AS asked_at, CASE event_type WHEN 'click' THEN 'save' ELSE 'unsave' END AS action,
 concat('job', lpad(replace(replace(props, '{"k": ', ''), '}', ''), 12, '0')) AS job_id
 FROM events WHERE event_type IN ('click', 'error')"""


@query(
    "U6_apply_saves",
    f"""WITH r AS (SELECT user_id, job_id, max_by(action, asked_at) AS action FROM ({_REQUESTS}) x GROUP BY user_id, job_id)
 SELECT user_id, job_id FROM v_saved s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id
  AND r.job_id = s.job_id AND r.action = 'unsave')
 UNION SELECT user_id, job_id FROM r WHERE action = 'save' AND job_id IN (SELECT id FROM v_job)""",
)
def apply_saves(t):
    return sets.apply_saves(t.v_saved, t.sql(_REQUESTS), t.v_job).select("user_id", "job_id")


# ------------------------------------------------------------------ table changes


@query(
    "S15_seed_companies",
    """SELECT slug, name FROM v_company UNION ALL
 SELECT DISTINCT concat('company-', CAST(p_partkey AS VARCHAR)) AS slug, p_name AS name FROM part
 WHERE concat('company-', CAST(p_partkey AS VARCHAR)) NOT IN (SELECT slug FROM v_company)""",
)
def seed(t):
    seed_rows = t.part.select(F.concat(F.lit("company-"), F.col("p_partkey")).alias("slug"), F.col("p_name").alias("name"))
    return tables.seed_companies(t.v_company.select("slug", "name"), seed_rows)


@query(
    "S21_insert_missing",
    """SELECT user_id, job_id FROM v_saved UNION SELECT user_id, job_id FROM v_click""",
)
def insert_missing(t):
    return tables.insert_missing(t.v_saved.select("user_id", "job_id"), t.v_click.select("user_id", "job_id"), ["user_id", "job_id"])


@query(
    "S22_upsert",
    """WITH c AS (SELECT user_id, job_id, min(created_at) AS first_at, max(created_at) AS last_at FROM v_click GROUP BY 1, 2)
 SELECT coalesce(a.user_id, c.user_id) AS user_id, coalesce(a.job_id, c.job_id) AS job_id,
  coalesce(a.created_at, c.first_at) AS created_at,
  greatest(coalesce(a.last_clicked_at, c.last_at), coalesce(c.last_at, a.last_clicked_at)) AS last_clicked_at,
  coalesce(a.stage, 'APPLIED') AS stage
 FROM v_application a FULL OUTER JOIN c ON a.user_id = c.user_id AND a.job_id = c.job_id""",
)
def upsert(t):
    clicks = t.v_click.groupBy("user_id", "job_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("last_clicked_at")
    )
    return tables.upsert(
        t.v_application,
        clicks,
        ["user_id", "job_id"],
        update={"last_clicked_at": F.greatest("t.last_clicked_at", "s.last_clicked_at")},
        insert={"stage": F.lit("APPLIED")},
    )


@query(
    "S23_cascade_delete",
    f"""WITH gone AS (SELECT user_id FROM v_candidate WHERE user_id % 10 = 3)
 SELECT 'saved_job' AS tbl, count(*) AS n FROM v_saved WHERE user_id NOT IN (SELECT user_id FROM gone)
 UNION ALL SELECT 'job_application', count(*) FROM v_application WHERE user_id NOT IN (SELECT user_id FROM gone)
 UNION ALL SELECT 'apply_click', count(*) FROM v_click
 UNION ALL SELECT 'job', count(*) FROM v_job
 UNION ALL SELECT 'job_posted', count(*) FROM ({_POSTED}) p WHERE posted_by_id IS NOT NULL
  AND posted_by_id NOT IN (SELECT user_id FROM gone)""",
)
def cascade(t):
    before = {"saved_job": t.v_saved, "job_application": t.v_application, "apply_click": t.v_click, "job": t.sql(_POSTED)}
    after = tables.cascade_delete(before, t.v_candidate.filter(F.col("user_id") % 10 == 3))
    after["job_posted"] = after["job"].filter(F.col("posted_by_id").isNotNull())
    counts = None
    for name, df in after.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts
