"""Registered queries: suggestions and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.operators.overlap import overlap_counts
from rolecall.plans import recommend, suggest

_VOCAB = """SELECT kind, label, key, n AS count, slug FROM (
 SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, slug) AS r FROM (
  SELECT 0 AS o, 'company' AS kind, c.name AS label, lower(c.name) AS key, count(*) AS n, c.slug FROM v_company c
   JOIN v_job j ON j.company_id = c.id WHERE j.status = 'ACTIVE' GROUP BY c.name, c.slug
  UNION ALL SELECT 1, 'title', title, title, count(*), NULL FROM v_job WHERE status = 'ACTIVE' GROUP BY title
  UNION ALL SELECT 2, 'skill', tag, lower(tag), count(*), NULL FROM v_job_tag WHERE job_id IN
   (SELECT id FROM v_job WHERE status = 'ACTIVE') GROUP BY tag) x) y WHERE r = 1"""


@query("A14_suggest_vocabulary", _VOCAB)
def vocabulary(t):
    return suggest.keyword_vocabulary(t.job, t.v_company)


@query(
    "A14_place_vocabulary",
    """SELECT 'city' AS kind, c.city AS label, lower(replace(c.city, '_', ' ')) AS key, count(*) AS count, 0 AS aliases
 FROM (SELECT DISTINCT n_name AS city FROM nation) c JOIN v_job j ON contains(j.location, c.city) WHERE j.status = 'ACTIVE' GROUP BY c.city
 UNION ALL SELECT 'remote', 'Remote', 'remote', count(*), 4 FROM v_job WHERE status = 'ACTIVE' AND remote = 'REMOTE'""",
)
def places(t):
    cities = [f"NATION_{i}" for i in range(25)]
    return suggest.place_vocabulary(t.v_job, cities).withColumn("aliases", F.size("alt")).drop("alt")


_TERMS = """SELECT DISTINCT typed AS term_id, typed FROM (
 SELECT lower(substr(p_type, 1, 3)) AS typed FROM part
 UNION ALL SELECT concat(lower(p_type), ' ', substr(p_name, 1, 3)) FROM part
 UNION ALL SELECT concat('  ', substr(p_name, 1, 6)) FROM part
 UNION ALL SELECT substr(s_name, 1, 17) FROM supplier
 UNION ALL SELECT '' FROM region) x"""


@query(
    "L10_suggest",
    f"""WITH vocab AS ({_VOCAB}), term AS (SELECT term_id, typed, lower(trim(typed)) AS term FROM ({_TERMS}) t WHERE trim(typed) <> ''),
 hit AS (SELECT t.term_id, v.*, CASE kind WHEN 'company' THEN 0 WHEN 'title' THEN 1 ELSE 2 END AS o,
  CASE WHEN v.key = t.term THEN -1 WHEN starts_with(v.key, t.term) THEN 0 WHEN contains(v.key, ' ' || t.term) THEN 1
   WHEN len(string_split(t.term, ' ')) > 1 AND len(list_filter(string_split(t.term, ' '),
    lambda w: NOT (starts_with(v.key, w) OR contains(v.key, ' ' || w)))) = 0 THEN 2 END AS tier FROM term t, vocab v),
 k AS (SELECT *, row_number() OVER (PARTITION BY term_id, kind ORDER BY tier, count DESC, length(label), lower(label), label) AS kr
  FROM hit WHERE tier IS NOT NULL),
 p AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY tier, count DESC, o, length(label), lower(label), label) AS pos
  FROM k WHERE kr <= CASE WHEN kind = 'title' THEN 8 ELSE 3 END)
 SELECT term_id, pos, kind, label, slug FROM p WHERE pos <= 8""",
)
def completions(t):
    vocab = suggest.keyword_vocabulary(t.job, t.v_company)
    return suggest.suggest_keywords(vocab, t.sql(_TERMS)).drop("mark")


@query(
    "F15_highlight_range",
    """WITH w AS (SELECT id, lower(title) AS label, split_part(lower(title), ' ', 2) AS word FROM v_job)
 SELECT id, CASE WHEN starts_with(label, word) THEN 0 ELSE length(split_part(label, ' ', 1)) + 1 END AS mark_start,
  CASE WHEN starts_with(label, word) THEN 0 ELSE length(split_part(label, ' ', 1)) + 1 END + length(word) AS mark_end FROM w""",
)
def highlights(t):
    """The second word of a title typed in capitals, every other time with a word that is not there."""
    odd = F.when(F.substring("id", 14, 1).cast("int") % 2 == 1, " zzz").otherwise("")
    typed = F.concat(F.lit("  "), F.upper(F.split("title", " ")[1]), odd, F.lit(" "))
    marked = t.v_job.select("id", suggest.highlight_range(F.col("title"), typed).alias("m"))
    return marked.select("id", F.col("m.start").alias("mark_start"), F.col("m.end").alias("mark_end"))


# Places as a board in India has them, by the job's place number.
_CITY_JOBS = """SELECT id, status, remote, CASE CAST(substr(location, 8) AS BIGINT) % 7 WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'Gurugram'
 WHEN 2 THEN 'Noida' WHEN 3 THEN 'Delhi' WHEN 4 THEN 'Mumbai · Pune' WHEN 5 THEN 'Pune' ELSE 'India' END AS location FROM v_job"""
_PLACE_TERMS = """SELECT DISTINCT user_id % 6 AS term_id, CASE user_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'ncr' WHEN 2 THEN 'Bang'
 WHEN 3 THEN 'pu' WHEN 4 THEN 'work from' ELSE 'zzz' END AS typed FROM v_candidate"""


@query(
    "L10_suggest_places",
    f"""WITH j AS (SELECT * FROM ({_CITY_JOBS}) x WHERE status = 'ACTIVE'),
 v AS (SELECT c.label, count(*) AS n FROM (SELECT * FROM (VALUES ('Bengaluru'), ('Gurugram'), ('Noida'), ('Delhi'), ('Mumbai'), ('Pune'))
   w(label)) c JOIN j ON contains(j.location, c.label) GROUP BY c.label
  UNION ALL SELECT 'Remote', count(*) FROM j WHERE remote = 'REMOTE'),
 h AS (SELECT t.term_id, v.label, v.n, CASE WHEN t.typed = 'ncr' THEN 'NCR' WHEN t.typed = 'Bang' THEN 'Bangalore'
   WHEN t.typed = 'work from' THEN 'Work from home' END AS alias, CASE WHEN t.typed = 'ncr' THEN -1 ELSE 0 END AS tier
  FROM ({_PLACE_TERMS}) t JOIN v ON (t.typed = '' OR (t.typed = 'ncr' AND v.label IN ('Gurugram', 'Noida', 'Delhi'))
   OR (t.typed = 'Bang' AND v.label = 'Bengaluru') OR (t.typed = 'pu' AND v.label = 'Pune')
   OR (t.typed = 'work from' AND v.label = 'Remote')))
 SELECT term_id, row_number() OVER (PARTITION BY term_id ORDER BY tier, n DESC, CASE WHEN label = 'Remote' THEN 1 ELSE 0 END,
  length(label), label) AS pos, CASE WHEN label = 'Remote' THEN 'remote' ELSE 'city' END AS kind, label, alias FROM h""",
)
def place_completions(t):
    vocab = suggest.place_vocabulary(t.sql(_CITY_JOBS))
    return suggest.suggest_places(vocab, t.sql(_PLACE_TERMS)).drop("mark")


# ------------------------------------------------------------------ matching


@query(
    "J8_skill_overlap",
    """SELECT skill, level, count(*) AS candidates, max(roles) AS roles FROM (
 SELECT s.skill, j.level, s.user_id, j.roles FROM v_candidate_skill s JOIN (
  SELECT t.tag, j.level, count(*) AS roles FROM v_job j JOIN v_job_tag t ON t.job_id = j.id WHERE j.status = 'ACTIVE'
  GROUP BY t.tag, j.level) j ON j.tag = s.skill GROUP BY s.skill, j.level, s.user_id, j.roles) x GROUP BY skill, level""",
)
def overlap(t):
    """Array overlap as an equi-join on the exploded values, both sides counted first."""
    open_roles = t.job.filter(F.col("status") == "ACTIVE").select("id", "level", F.explode(F.array_distinct("tags")).alias("skill"))
    roles = open_roles.groupBy("skill", "level").agg(F.count(F.lit(1)).alias("roles"))
    people = t.candidate.select("user_id", F.explode(F.array_distinct("skills")).alias("skill"))
    people = people.groupBy("skill").agg(F.count(F.lit(1)).alias("candidates"))
    return people.join(roles, "skill").select("skill", "level", "candidates", "roles")


@query(
    "J8_distinct_overlap",
    """SELECT j.id, count(DISTINCT s.user_id) AS candidates FROM v_job j LEFT JOIN v_job_tag t ON t.job_id = j.id
 LEFT JOIN v_candidate_skill s ON s.skill = t.tag WHERE j.status = 'ACTIVE' GROUP BY j.id""",
)
def distinct_overlap(t):
    """For every open role the candidates who share a skill with it, each counted once."""
    roles = t.job.filter(F.col("status") == "ACTIVE").select("id", "tags")
    return overlap_counts(t.candidate, "skills", roles, "tags", "candidates").drop("tags")


_LEVELS_SQL = """CASE WHEN c.years_experience IS NULL THEN true WHEN c.years_experience <= 0 THEN j.level IN ('INTERN', 'JUNIOR')
 WHEN c.years_experience = 1 THEN j.level IN ('JUNIOR', 'MID') WHEN c.years_experience <= 3 THEN j.level IN ('JUNIOR', 'MID', 'SENIOR')
 WHEN c.years_experience <= 6 THEN j.level IN ('MID', 'SENIOR') WHEN c.years_experience <= 9 THEN j.level IN ('SENIOR', 'STAFF', 'MANAGER')
 WHEN c.years_experience <= 13 THEN j.level IN ('SENIOR', 'STAFF', 'PRINCIPAL', 'MANAGER')
 ELSE j.level IN ('STAFF', 'PRINCIPAL', 'MANAGER', 'DIRECTOR') END"""

_SHORT_SQL = """concat('Pays up to ₹', CASE WHEN j.salary_max >= 10000000
 THEN concat(CAST(CAST(floor(j.salary_max / 1000000.0 + 0.5) AS BIGINT) // 10 AS VARCHAR),
  CASE WHEN CAST(floor(j.salary_max / 1000000.0 + 0.5) AS BIGINT) % 10 = 0 THEN '' ELSE concat('.', CAST(CAST(floor(j.salary_max / 1000000.0 + 0.5) AS BIGINT) % 10 AS VARCHAR)) END, ' Cr')
 ELSE concat(CAST(CAST(floor(j.salary_max / 10000.0 + 0.5) AS BIGINT) // 10 AS VARCHAR),
  CASE WHEN CAST(floor(j.salary_max / 10000.0 + 0.5) AS BIGINT) % 10 = 0 THEN '' ELSE concat('.', CAST(CAST(floor(j.salary_max / 10000.0 + 0.5) AS BIGINT) % 10 AS VARCHAR)) END, ' L') END)"""


def _scored_sql(pairs: str) -> str:
    """Scores of the (user_id, id) rows of `pairs`, with skills in tag order."""
    return f"""SELECT p.user_id, p.id, j.posted_at, coalesce(m.n, 0) AS n, coalesce(m.tags, '') AS matched,
  least(coalesce(m.n, 0), 4) * 3 + CASE WHEN c.years_experience IS NOT NULL AND {_LEVELS_SQL} THEN 4 ELSE 0 END
  + CASE WHEN j.remote = 'REMOTE' THEN 1 WHEN contains(lower(j.location), lower(c.city)) THEN 3 ELSE 0 END
  + CASE WHEN j.currency = 'INR' AND j.salary_max IS NOT NULL THEN 1 ELSE 0 END
  + CASE WHEN j.currency = 'INR' AND j.salary_max >= c.expected_salary THEN 4 ELSE 0 END AS score,
  concat_ws('; ', CASE WHEN m.n > 2 THEN concat(m.one, ', ', m.two, ' and ', CAST(m.n - 2 AS VARCHAR), ' more match')
    WHEN m.n = 2 THEN concat(m.one, ' and ', m.two, ' match') WHEN m.n = 1 THEN concat(m.one, ' matches') END,
   CASE WHEN j.remote = 'REMOTE' THEN 'Remote' WHEN contains(lower(j.location), lower(c.city)) THEN concat('In ', c.city) END,
   CASE WHEN j.currency = 'INR' AND j.salary_max >= c.expected_salary THEN {_SHORT_SQL} END) AS reasons
 FROM ({pairs}) p JOIN v_job j ON j.id = p.id JOIN v_candidate c ON c.user_id = p.user_id
 LEFT JOIN (SELECT p.user_id, p.id, count(*) AS n, string_agg(t.tag, ',' ORDER BY t.tag) AS tags, min(t.tag) AS one,
   list(t.tag ORDER BY t.tag)[2] AS two FROM ({pairs}) p JOIN v_job_tag t ON t.job_id = p.id
   JOIN (SELECT DISTINCT user_id, skill FROM v_candidate_skill) s ON s.user_id = p.user_id AND s.skill = t.tag
   GROUP BY p.user_id, p.id) m ON m.user_id = p.user_id AND m.id = p.id"""


_POOL_SQL = f"""SELECT user_id, id FROM (SELECT c.user_id, j.id, row_number() OVER (PARTITION BY c.user_id
   ORDER BY j.posted_at DESC, j.id DESC) AS r FROM v_candidate c JOIN (SELECT DISTINCT s.user_id, t.job_id FROM v_candidate_skill s
   JOIN v_job_tag t ON t.tag = s.skill) o ON o.user_id = c.user_id JOIN v_job j ON j.id = o.job_id
  WHERE j.status = 'ACTIVE' AND {_LEVELS_SQL}
   AND NOT EXISTS (SELECT 1 FROM v_application a WHERE a.user_id = c.user_id AND a.job_id = j.id)) x WHERE r <= 150"""


@query("W3_match_pool", _POOL_SQL)
def pools(t):
    return recommend.match_pools(t.candidate, t.job, t.v_application).select("user_id", "id")


@query(
    "L7_recommend_jobs",
    f"""WITH pool AS ({_POOL_SQL})
 SELECT user_id, pos, id, score, matched, reasons FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY score DESC, posted_at DESC, id DESC) AS pos FROM ({_scored_sql('SELECT user_id, id FROM pool')}) s) x WHERE pos <= 12""",
)
def recommendations(t):
    best = recommend.recommend_jobs(t.candidate, t.job, t.v_application)
    return best.select(
        "user_id", "pos", "id", "score", F.array_join("matched_skills", ",").alias("matched"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query(
    "L8_score_job",
    f"SELECT user_id, id, score, matched, reasons FROM ({_scored_sql('SELECT user_id, job_id AS id FROM v_application')}) s",
)
def scores(t):
    pairs = t.v_application.select("user_id", F.col("job_id").alias("id"))
    scored = recommend.score_job(pairs.join(t.job, "id").join(t.candidate, "user_id"))
    return scored.select(
        "user_id", "id", "score", F.array_join("matched_skills", ",").alias("matched"), F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "L9_matching_readiness",
    """SELECT c.user_id, s.user_id IS NOT NULL AS ready, concat_ws(', ', CASE WHEN s.user_id IS NULL THEN 'your skills' END,
 CASE WHEN c.years_experience IS NULL THEN 'your years of experience' END) AS missing,
 CASE WHEN s.user_id IS NULL THEN 'latest-nudge' WHEN a.user_id IS NOT NULL THEN 'recommended' ELSE 'latest' END AS view
 FROM v_candidate c LEFT JOIN (SELECT DISTINCT user_id FROM v_candidate_skill) s ON s.user_id = c.user_id
 LEFT JOIN (SELECT DISTINCT user_id FROM v_application) a ON a.user_id = c.user_id""",
)
def readiness(t):
    ready = recommend.matching_readiness(t.candidate, t.v_application)
    return ready.select("user_id", "ready", F.array_join("missing", ", ").alias("missing"), "view")


@query(
    "L11_city_aliases",
    """WITH j AS (SELECT CAST(substr(location, 8) AS BIGINT) % 4 AS k FROM v_job)
 SELECT CASE WHEN x.a = 1 THEN 'Gurugram' WHEN x.a = 2 THEN 'Noida' ELSE 'Delhi' END AS city, count(*) AS jobs
 FROM j, (SELECT * FROM (VALUES (1), (2), (3)) v(a)) x WHERE k = 1 GROUP BY 1
 UNION ALL SELECT CASE k WHEN 0 THEN 'Chennai' WHEN 2 THEN 'Bengaluru' ELSE 'Mumbai' END, count(*) FROM j WHERE k <> 1 GROUP BY 1""",
)
def aliases(t):
    """Places typed by other names, resolved: NCR stands for each of its cities."""
    k = F.substring("location", 8, 3).cast("int") % 4
    typed = F.when(k == 1, "NCR").when(k == 2, "BLR").when(k == 3, "Bombay").otherwise("Madras")
    counted = t.v_job.select(typed.alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
    table = suggest.city_aliases(t.spark)
    return counted.join(table, "alias").groupBy("city").agg(F.sum("n").alias("jobs"))
