"""Registered queries: moderation, recruiter and operator actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.catalog.ingest import as_of
from rolecall.plans import activity
from rolecall.plans.views import AS_OF

_JOBS = """SELECT id, CAST(substr(id, 4) AS BIGINT) AS k, company_id, status, CAST(substr(id, 4) AS BIGINT) % 40 AS posted_by_id, 'old note' AS moderation_note,
 TIMESTAMP '2024-01-02 00:00:00' AS reviewed_at, posted_at, last_verified_at FROM v_job"""


@query(
    "L19_moderation_apply",
    f"""SELECT id, CASE WHEN status <> 'PENDING' OR k % 3 = 2 THEN status WHEN k % 3 = 0 THEN 'ACTIVE' ELSE 'REJECTED' END AS status,
 CASE WHEN status <> 'PENDING' OR k % 3 = 2 THEN 'old note' WHEN k % 3 = 1 THEN 'too vague' END AS moderation_note,
 CASE WHEN status = 'PENDING' AND k % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE posted_at END AS posted_at,
 CASE WHEN status = 'PENDING' AND k % 3 = 2 THEN 1 ELSE 0 END AS refused FROM ({_JOBS}) j""",
)
def moderation(t):
    """A third of the queue approved, a third turned down, a third turned down without a reason."""
    jobs = t.sql(_JOBS)
    decisions = jobs.filter(F.col("status") == "PENDING").select(
        "id",
        F.when(F.col("k") % 3 == 0, "APPROVED").otherwise("REJECTED").alias("decision"),
        F.when(F.col("k") % 3 == 1, " too vague ").alias("review_note"),
    )
    change = activity.apply_moderation(jobs, decisions, as_of(), job=True)
    refused = change.refused.select("id", F.lit(1).alias("_r"))
    table = change.table.join(refused, "id", "left")
    return table.select("id", "status", "moderation_note", "posted_at", F.coalesce("_r", F.lit(0)).alias("refused"))


_ALLOWED = """SELECT user_id, company_id FROM (SELECT user_id, company_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, company_id) AS r
 FROM v_member WHERE status = 'APPROVED') x WHERE r = 1"""
_STATES = """SELECT id, k, company_id, CASE WHEN k % 5 = 0 THEN 'CLOSED' ELSE status END AS status, k % 100 AS posted_by_id, last_verified_at,
 CAST(NULL AS STRING) AS moderation_note, CAST(NULL AS TIMESTAMP) AS reviewed_at FROM (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM v_job) b"""


@query(
    "L20_job_state_machine",
    f"""WITH j AS (SELECT s.*, CASE k % 4 WHEN 0 THEN 'CLOSE' WHEN 1 THEN 'RENEW' WHEN 2 THEN 'REOPEN' ELSE 'EDIT' END AS intent,
  a.user_id IS NOT NULL AS mine FROM ({_STATES}) s LEFT JOIN ({_ALLOWED}) a ON a.user_id = s.posted_by_id AND a.company_id = s.company_id),
 d AS (SELECT *, CASE WHEN NOT mine THEN 'not your listing' WHEN intent = 'RENEW' AND status <> 'ACTIVE' THEN 'only a live listing can be renewed'
  WHEN intent = 'REOPEN' AND status <> 'CLOSED' THEN 'not closed' END AS why FROM j)
 SELECT id, why, CASE WHEN why IS NOT NULL THEN status WHEN intent = 'CLOSE' THEN 'CLOSED' WHEN intent = 'REOPEN' THEN 'PENDING'
  WHEN intent = 'EDIT' AND status <> 'CLOSED' THEN 'PENDING' ELSE status END AS status,
  CASE WHEN why IS NULL AND intent IN ('RENEW', 'REOPEN') THEN TIMESTAMP '{AS_OF}' ELSE last_verified_at END AS last_verified_at FROM d""",
)
def states(t):
    jobs = t.sql(_STATES)
    k = F.col("k") % 4
    intents = jobs.select(
        F.col("posted_by_id").alias("user_id"),
        F.col("id").alias("job_id"),
        F.when(k == 0, "CLOSE").when(k == 1, "RENEW").when(k == 2, "REOPEN").otherwise("EDIT").alias("intent"),
    )
    change = activity.recruiter_intents(jobs, intents, t.v_member, t.v_candidate.select("user_id"), as_of())
    refused = change.refused.select(F.col("job_id").alias("id"), "why")
    return change.table.join(refused, "id", "left").select("id", "why", "status", "last_verified_at")


_MEMBERS = """SELECT user_id, company_id, status, created_at, 'old@acme.com' AS work_email, CAST(NULL AS STRING) AS note,
 CAST('no' AS STRING) AS review_note, created_at AS reviewed_at FROM v_member"""
_CLAIMS = """SELECT c_custkey AS user_id, c_custkey % 37 + CASE WHEN c_custkey % 9 = 0 THEN 5 ELSE 0 END AS company_id,
 CASE c_custkey % 4 WHEN 0 THEN 'a@gmail.com' WHEN 1 THEN 'a@Acme.com' WHEN 2 THEN 'nobody' ELSE 'b@corp.in' END AS work_email,
 'please' AS note, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM customer"""


@query(
    "L21_claim_upsert",
    f"""WITH c AS (SELECT * FROM ({_CLAIMS}) x WHERE user_id % 4 IN (1, 3) AND company_id IN (SELECT id FROM v_company))
 SELECT coalesce(m.user_id, c.user_id) AS user_id, coalesce(m.company_id, c.company_id) AS company_id,
  CASE WHEN m.status IS NULL OR (m.status = 'REJECTED' AND c.user_id IS NOT NULL) THEN 'PENDING' ELSE m.status END AS status,
  CASE WHEN m.status IS NULL OR (m.status = 'REJECTED' AND c.user_id IS NOT NULL) THEN c.work_email ELSE m.work_email END AS work_email,
  CASE WHEN m.status IS NULL OR (m.status = 'REJECTED' AND c.user_id IS NOT NULL) THEN NULL ELSE m.review_note END AS review_note
 FROM ({_MEMBERS}) m FULL OUTER JOIN c ON c.user_id = m.user_id AND c.company_id = m.company_id""",
)
def claims(t):
    change = activity.claim_companies(t.sql(_MEMBERS), t.sql(_CLAIMS), t.v_company)
    return change.table.select("user_id", "company_id", "status", "work_email", "review_note")


@query(
    "L21_claim_refused",
    f"""SELECT user_id, company_id, CASE user_id % 4 WHEN 0 THEN 'personal email address' ELSE 'not an email address' END AS why
 FROM ({_CLAIMS}) c WHERE user_id % 4 IN (0, 2) UNION ALL
 SELECT user_id, company_id, 'unknown company' FROM ({_CLAIMS}) c WHERE user_id % 4 IN (1, 3) AND company_id NOT IN (SELECT id FROM v_company)""",
)
def refused_claims(t):
    return activity.claim_companies(t.sql(_MEMBERS), t.sql(_CLAIMS), t.v_company).refused


@query(
    "L22_rename_company",
    """SELECT id, CASE WHEN company_id % 10 = 4 THEN lower(concat(title, ' renamed ', CAST(company_id AS VARCHAR), ' inc ', location,
 CASE WHEN tags <> '' THEN concat(' ', tags) ELSE '' END)) ELSE search_text END AS search_text
 FROM (SELECT j.*, coalesce(g.tags, '') AS tags FROM v_job j LEFT JOIN (SELECT job_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM v_job_tag
  GROUP BY job_id) g ON g.job_id = j.id) x""",
)
def rename(t):
    renamed = t.v_company.filter(F.col("id") % 10 == 4).select("id", F.concat(F.lit("Renamed  "), "id", F.lit(" Inc")).alias("name"))
    jobs = t.job.withColumn("remote_region", F.lit(None).cast("string"))
    return activity.rename_companies(jobs, renamed).select("id", "search_text")


@query(
    "L23_company_slug",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 40 = 1 THEN concat(c_mktsegment, ' Group') ELSE c_mktsegment END AS name,
  lower(CASE WHEN c_custkey % 40 = 1 THEN concat(c_mktsegment, '-group') ELSE c_mktsegment END) AS base,
  TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 30) * INTERVAL '1' DAY AS created_at FROM customer),
 s AS (SELECT lower(concat(c_mktsegment, '-', CAST(c_custkey AS VARCHAR))) AS slug FROM customer WHERE c_custkey % 50 = 0),
 r AS (SELECT a.c_custkey, a.base, count(b.c_custkey) + (SELECT count(*) FROM s WHERE starts_with(s.slug, a.base)) AS taken FROM n a
  LEFT JOIN n b ON starts_with(b.base, a.base) AND (b.created_at, b.name, b.c_custkey) < (a.created_at, a.name, a.c_custkey) GROUP BY a.c_custkey, a.base)
 SELECT CASE WHEN taken = 0 THEN base ELSE concat(base, '-', CAST(taken + 1 AS VARCHAR)) END AS slug FROM r""",
)
def slugs(t):
    new = t.customer.select(
        F.concat("c_mktsegment", F.when(F.col("c_custkey") % 40 == 1, " Group").otherwise("")).alias("name"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 30).cast("int"))).alias("created_at"),
    )
    stored = t.customer.filter(F.col("c_custkey") % 50 == 0).select(F.lower(F.concat_ws("-", "c_mktsegment", "c_custkey")).alias("slug"))
    return activity.company_slugs(stored, new).select("slug")


@query(
    "L24_set_stage",
    f"""SELECT user_id, job_id, CASE WHEN user_id % 3 = 0 THEN 'OFFER' ELSE stage END AS stage,
 CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' END AS stage_updated_at, 0 AS missed FROM v_application
 UNION ALL SELECT user_id, 'job999999999999', NULL, NULL, 1 FROM (SELECT DISTINCT user_id FROM v_application) u WHERE user_id % 3 = 0""",
)
def set_stage(t):
    stored = t.v_application.select(
        "user_id", "job_id", "stage", F.lit(None).cast("string").alias("note"), F.lit(None).cast("timestamp").alias("stage_updated_at")
    )
    chosen = stored.filter(F.col("user_id") % 3 == 0)
    wrong = chosen.select("user_id").distinct().withColumn("job_id", F.lit("job999999999999"))
    changes = chosen.select("user_id", "job_id").unionByName(wrong).select("*", F.lit("OFFER").alias("stage"), F.lit("yes").alias("note"))
    change = activity.set_stages(stored, changes, as_of())
    kept = change.table.select("user_id", "job_id", "stage", "stage_updated_at", F.lit(0).alias("missed"))
    return kept.unionByName(change.refused.withColumn("missed", F.lit(1)), allowMissingColumns=True)


_USERS = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'SEEKER' WHEN 1 THEN 'RECRUITER' ELSE 'ADMIN' END AS role FROM customer"


@query(
    "L25_promote_role",
    f"SELECT id, CASE WHEN role = 'SEEKER' AND id IN (SELECT user_id FROM v_member) THEN 'RECRUITER' ELSE role END AS role FROM ({_USERS}) u",
)
def promote(t):
    return activity.promote_recruiters(t.sql(_USERS), t.v_member.select("user_id"))


@query(
    "L26_admin_job_actions",
    f"""SELECT id, CASE k % 6 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'EXPIRED' WHEN 2 THEN 'ACTIVE' ELSE status END AS status,
 CASE WHEN k % 6 IN (0, 2, 3) THEN TIMESTAMP '{AS_OF}' ELSE last_verified_at END AS last_verified_at FROM ({_JOBS}) j WHERE k % 6 <> 4""",
)
def admin(t):
    jobs = t.sql(_JOBS)
    k = F.col("k") % 6
    action = F.when(k == 0, "ACTIVATE").when(k == 1, "EXPIRE").when(k == 2, "CONFIRM").when(k == 3, "EDIT").when(k == 4, "DELETE")
    actions = jobs.select("id", action.alias("action")).dropna()
    return activity.admin_job_actions(jobs, actions, as_of()).select("id", "status", "last_verified_at")
