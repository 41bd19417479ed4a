"""Registered queries: integrity rules and input validation (Q operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.operators import quality

# Stored rows with every kind of damage the rules look for.
_BROKEN = """SELECT id, salary_disclosed, CASE WHEN k % 10 = 1 THEN NULL WHEN k % 10 = 2 THEN 0 ELSE salary_min END AS salary_min, salary_max,
 CASE WHEN k % 10 = 3 THEN NULL ELSE currency END AS currency, CASE WHEN k % 10 = 4 THEN NULL WHEN k % 10 = 5 THEN 41 ELSE experience_min END AS experience_min,
 CASE WHEN k % 10 = 6 THEN 0 ELSE experience_max END AS experience_max, source, CASE WHEN k % 100 = 7 THEN 'twice' ELSE id END AS external_id,
 CASE WHEN k % 50 = 9 THEN 999999 ELSE company_id END AS company_id
 FROM (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM v_job) b"""


@query(
    "Q1_check_constraints",
    f"""SELECT 'job' AS "table", id AS key, 'salary_band' AS rule FROM ({_BROKEN}) j WHERE NOT coalesce(
  CASE WHEN salary_min IS NULL AND salary_max IS NULL AND currency IS NULL AND NOT salary_disclosed THEN true
   WHEN currency IS NULL OR NOT salary_disclosed THEN false WHEN salary_min IS NULL OR salary_max IS NULL THEN NULL
   ELSE salary_min > 0 AND salary_max >= salary_min END, true)
 UNION ALL SELECT 'job', id, 'experience' FROM ({_BROKEN}) j WHERE CASE WHEN experience_min IS NULL THEN experience_max IS NOT NULL
  WHEN experience_min > 40 THEN true ELSE coalesce(experience_max < experience_min OR experience_max > 40, false) END
 UNION ALL SELECT 'candidate_profile', CAST(c_custkey AS VARCHAR), rule FROM (
  SELECT c_custkey, unnest([CASE WHEN c_custkey % 3 = 1 THEN 'resume' END, CASE WHEN c_custkey % 70 > 60 THEN 'years' END,
   CASE WHEN c_custkey % 5 = 0 THEN 'current_salary' END, CASE WHEN c_custkey % 200 > 180 THEN 'notice_period' END]) AS rule FROM customer) p
  WHERE rule IS NOT NULL""",
)
def constraints(t):
    k = F.col("c_custkey")
    profiles = t.customer.select(
        k,
        F.when(k % 3 != 0, "key").alias("resume_key"),
        F.when(k % 3 != 0, "cv.pdf").alias("resume_filename"),
        F.when(k % 3 == 1, 5_000_000).when(k % 3 == 2, 1000).alias("resume_size"),
        F.when(k % 3 != 0, "application/pdf").alias("resume_type"),
        (k % 70).alias("years_experience"),
        F.when(k % 5 == 0, 999).otherwise(1_000_000).alias("current_salary"),
        F.lit(None).cast("long").alias("expected_salary"),
        (k % 200).alias("notice_period"),
        F.array(F.lit("Go")).alias("skills"),
    )
    jobs = quality.check_constraints(t.sql(_BROKEN), "job", "id")
    return jobs.unionByName(quality.check_constraints(profiles, "candidate_profile", "c_custkey"))


@query(
    "Q2_check_keys",
    f"""SELECT 'job' AS "table", concat(source, '/', external_id) AS key, 'unique source,external_id' AS rule FROM ({_BROKEN}) j
  GROUP BY source, external_id HAVING count(*) > 1
 UNION ALL SELECT 'job', id, 'reference company_id' FROM ({_BROKEN}) j WHERE company_id NOT IN (SELECT id FROM v_company)
 UNION ALL SELECT 'apply_click', CAST(event_id AS VARCHAR), 'reference job_id' FROM v_click WHERE job_id NOT IN (SELECT id FROM v_job)
 UNION ALL SELECT 'review', NULL, NULL FROM region WHERE false""",
)
def keys(t):
    jobs = t.sql(_BROKEN)
    found = [
        quality.check_unique(jobs, "job", ["source", "external_id"]),
        quality.check_reference(jobs, "job", ["id"], "company_id", t.v_company, "id"),
        quality.check_reference(t.v_click, "apply_click", ["event_id"], "job_id", t.v_job, "id"),
        quality.check_unique(t.v_review, "review", ["company_id", "user_id"]),
    ]
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    return rows


@query(
    "Q3_validate_jobs",
    """SELECT k, concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'title: too short' END, CASE WHEN k % 11 = 0 THEN 'description: too short' END,
 CASE WHEN k % 5 = 0 THEN 'remote: invalid' END, CASE WHEN k % 9 = 2 THEN 'salary_min: out of range' END,
 CASE WHEN k % 6 = 1 THEN 'experience_max: out of range' END, CASE WHEN k % 17 = 0 THEN 'apply_url: invalid' END,
 CASE WHEN k % 4 = 3 THEN 'salary_max: give both ends or neither' WHEN k % 4 = 2 AND k % 9 <> 2 THEN 'salary_max: below the minimum' END,
 CASE WHEN k % 8 = 4 AND k % 6 <> 0 THEN 'experience_min: give a minimum too' END,
 CASE WHEN k % 4 = 3 THEN 'salary_min: publish the band' END) AS errors FROM v_posting""",
)
def jobs(t):
    k = F.col("k")
    typed = t.v_posting.select(
        "k",
        F.when(k % 7 == 0, " ab ").otherwise(F.col("title")).alias("title"),
        F.when(k % 11 == 0, "short").otherwise(F.col("description")).alias("description"),
        "discipline",
        "level",
        F.lit("Pune").alias("location"),
        F.when(k % 5 == 0, "NEVER").otherwise("REMOTE").alias("remote"),
        F.when(k % 9 == 2, "many").otherwise("900000").alias("salary_min"),
        F.when(k % 4 == 3, "").when(k % 4 == 2, "800000").otherwise("1000000").alias("salary_max"),
        F.when(k % 8 == 4, "").otherwise("3").alias("experience_min"),
        F.when(k % 6 == 1, "41").when(k % 6 == 0, "").otherwise("5").alias("experience_max"),
        F.when(k % 17 == 0, "ftp://x").otherwise("https://x.example.com/a").alias("apply_url"),
    )
    cleaned = quality.clean_job_input(typed)
    return cleaned.select("k", F.array_join(quality.job_errors(cleaned, recruiter=True), "; ").alias("errors"))


@query(
    "Q4_validate_profiles",
    """SELECT c_custkey AS id, concat_ws('; ', CASE WHEN c_custkey % 6 = 0 THEN 'full_name: required' END, CASE WHEN c_custkey % 5 = 0 THEN 'phone: invalid' END,
 CASE WHEN c_custkey % 80 > 60 THEN 'years_experience: out of range' END, CASE WHEN c_custkey % 4 = 1 THEN 'linkedin_url: wrong address' END,
 CASE WHEN c_custkey % 3 = 2 THEN 'expected_salary: not an amount' END) AS errors FROM customer""",
)
def profiles(t):
    k = F.col("c_custkey")
    typed = t.customer.select(
        k.alias("id"),
        F.when(k % 6 == 0, "  ").otherwise(F.col("c_name")).alias("full_name"),
        F.when(k % 5 == 0, "call me").otherwise("+91 98765-43210").alias("phone"),
        (k % 80).cast("string").alias("years_experience"),
        F.when(k % 4 == 1, "https://example.com/in/a").when(k % 4 == 2, "").otherwise("https://in.linkedin.com/in/a").alias("linkedin_url"),
        F.when(k % 3 == 0, "₹18,00,000").when(k % 3 == 1, "24.5 LPA").otherwise("a lot").alias("expected_salary"),
    )
    return typed.select("id", F.array_join(quality.profile_errors(typed, 2024), "; ").alias("errors"))


@query(
    "Q4_validate_reviews",
    """SELECT company_id, user_id, concat_ws('; ', CASE WHEN rating = 5 THEN 'rating: give 1 to 5' END, CASE WHEN user_id % 3 = 0 THEN 'title: too short' END,
 CASE WHEN user_id % 4 = 0 THEN 'cons: too short' END) AS errors FROM v_review""",
)
def reviews(t):
    k = F.col("user_id") % 12
    typed = t.v_review.select(
        "company_id", "user_id",
        F.when(F.col("rating") == 5, "9").otherwise(F.col("rating").cast("string")).alias("rating"),
        F.when(k % 3 == 0, "bad").otherwise("Good place to learn").alias("title"),
        F.lit("Friendly team and real ownership").alias("pros"),
        F.when(k % 4 == 0, "nothing").otherwise("Meetings take most of the week").alias("cons"),
    )
    return typed.select("company_id", "user_id", F.array_join(quality.review_errors(typed), "; ").alias("errors"))


@query(
    "Q4_validate_companies",
    """SELECT id, concat_ws('; ', CASE WHEN id % 6 = 0 THEN 'website: invalid' END, CASE WHEN id % 4 = 3 THEN 'ats_token: wrong form' END,
 CASE WHEN id % 5 = 0 THEN 'median_response_days: out of range' END) AS errors FROM v_company""",
)
def companies(t):
    k = F.col("id")
    typed = t.v_company.select(
        "id", "name", "industry",
        F.when(k % 6 == 0, "example").otherwise("https://example.com").alias("website"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "ASHBY").otherwise("ORACLE").alias("ats_source"),
        F.when(k % 4 == 1, "one  two").when(k % 4 == 2, "a.fa.oraclecloud.com|CX_1|300").otherwise("board").alias("ats_token"),
        F.when(k % 5 == 0, "121").otherwise("14").alias("median_response_days"),
    )
    return typed.select("id", F.array_join(quality.company_errors(typed), "; ").alias("errors"))


@query(
    "Q4_validate_stages",
    """SELECT user_id, job_id, concat_ws('; ', CASE WHEN user_id % 7 = 0 THEN 'job_id: invalid' END, CASE WHEN user_id % 5 = 0 THEN 'stage: invalid' END) AS errors
 FROM v_application""",
)
def stages(t):
    typed = t.v_application.select(
        "user_id",
        F.col("job_id").alias("shown"),
        F.when(F.col("user_id") % 7 == 0, "x y").otherwise(F.col("job_id")).alias("job_id"),
        F.when(F.col("user_id") % 5 == 0, "HIRED").otherwise(F.col("stage")).alias("stage"),
    )
    errors = F.array_join(quality.stage_errors(typed), "; ").alias("errors")
    return typed.select("user_id", "shown", errors).withColumnRenamed("shown", "job_id")
