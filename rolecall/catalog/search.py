"""Registered queries: search filters, orders, joins (P, O and J operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.operators import pages
from rolecall.operators import filters as P
from rolecall.operators import sort as O
from rolecall.operators.filters import SearchParams
from rolecall.plans import search
from rolecall.plans.views import AS_OF

_ORDER = {
    "recommended": "salary_disclosed DESC, posted_at DESC, id DESC",
    "newest": "posted_at DESC, id DESC",
    "salary": "salary_disclosed DESC, CASE currency WHEN 'INR' THEN 4 WHEN 'USD' THEN 3 WHEN 'GBP' THEN 2 "
    "WHEN 'EUR' THEN 1 END DESC NULLS LAST, salary_max DESC NULLS LAST, salary_min DESC NULLS LAST, "
    "posted_at DESC, id DESC",
}


@query(
    "P1_job_card",
    """SELECT j.id, j.title, j.location, j.remote, j.salary_min, j.salary_max, j.currency, j.salary_disclosed,
 j.experience_min, j.experience_max, j.posted_at, c.name AS company_name, c.slug AS company_slug
 FROM v_job j JOIN v_company c ON c.id = j.company_id""",
)
def job_card(t):
    return search.job_card(t.v_job, t.v_company)


@query("P2_filter_active", "SELECT id FROM v_job WHERE status = 'ACTIVE'")
def active(t):
    return P.filter_active(t.v_job).select("id")


@query(
    "P3_filter_words",
    """SELECT id, title FROM v_job WHERE contains(search_text, 'ring') AND contains(search_text, 'promo')
 AND contains(search_text, 'nation_1')""",
)
def words(t):
    return t.v_job.filter(P.has_words("  Ring PROMO nation_1")).select("id", "title")


@query(
    "P4_filter_location",
    "SELECT id, 'text' AS kind FROM v_job WHERE contains(lower(location), 'nation_2') "
    "UNION ALL SELECT id, 'remote' AS kind FROM v_job WHERE remote = 'REMOTE'",
)
def location(t):
    jobs = t.v_job.withColumn("remote_region", F.lit(None).cast("string"))
    text = jobs.filter(P.in_location("NATION_2")).select("id", F.lit("text").alias("kind"))
    return text.unionByName(jobs.filter(P.in_location("Remote")).select("id", F.lit("remote").alias("kind")))


@query(
    "P5_filter_enums",
    "SELECT id FROM v_job WHERE status = 'ACTIVE' AND discipline = 'DATA' AND level = 'SENIOR' "
    "AND remote = 'ONSITE' AND currency = 'INR'",
)
def enums(t):
    params = SearchParams(discipline="DATA", level="SENIOR", remote="ONSITE", currency="INR")
    return t.v_job.filter(params.predicate()).select("id")


_BUCKET_SQL = """
 SELECT j.id, b.bucket FROM v_job j JOIN (
  SELECT * FROM (VALUES ('0-1', 0, 1), ('1-3', 1, 3), ('3-5', 3, 5), ('5-8', 5, 8), ('8-plus', 8, 1000)) v(bucket, lo, hi)
 ) b ON (
  CASE WHEN j.experience_min IS NOT NULL THEN j.experience_min ELSE
   CASE j.level WHEN 'INTERN' THEN 0 WHEN 'JUNIOR' THEN 0 WHEN 'MID' THEN 2 WHEN 'SENIOR' THEN 5
    WHEN 'PRINCIPAL' THEN 10 WHEN 'DIRECTOR' THEN 10 ELSE 8 END END < b.hi
  AND CASE WHEN j.experience_min IS NOT NULL THEN
    CASE WHEN j.experience_max IS NULL THEN j.experience_min + 2 ELSE greatest(j.experience_max, j.experience_min + 1) END
   ELSE CASE j.level WHEN 'INTERN' THEN 1 WHEN 'JUNIOR' THEN 2 WHEN 'MID' THEN 5 WHEN 'SENIOR' THEN 7
    WHEN 'PRINCIPAL' THEN 12 WHEN 'DIRECTOR' THEN 12 ELSE 10 END END > b.lo)"""


@query("P6_filter_experience", _BUCKET_SQL)
def experience(t):
    named = F.array_compact(F.array(*[F.when(P.in_experience(b), F.lit(b)) for b in P.BUCKETS]))
    return t.v_job.select("id", F.explode(named).alias("bucket"))


@query(
    "P7_filter_industry",
    "SELECT id FROM v_job WHERE company_id IN (SELECT id FROM v_company WHERE industry = 'FINTECH')",
)
def industry(t):
    return P.filter_industry(t.v_job, t.v_company, "FINTECH").select("id")


@query("P8_filter_city", "SELECT id FROM v_job WHERE status = 'ACTIVE' AND contains(location, 'NATION_7')")
def city(t):
    return t.v_job.filter(SearchParams(city="NATION_7").predicate()).select("id")


@query(
    "P9_filter_min_salary",
    "SELECT id, salary_max FROM v_job WHERE status = 'ACTIVE' AND salary_disclosed AND currency = 'INR' "
    "AND salary_max >= 2000000",
)
def min_salary(t):
    return t.v_job.filter(SearchParams(salary=True, min_salary=2_000_000).predicate()).select("id", "salary_max")


@query("P10_filter_tag", "SELECT job_id AS id FROM v_job_tag WHERE tag = 'PROMO' AND job_id IN (SELECT id FROM v_job)")
def tag(t):
    return t.job.filter(P.has_tag("PROMO")).select("id")


_SEARCH = SearchParams(q="widget", exp="3-5", min_salary=500_000)
_SEARCH_SQL = """SELECT * FROM v_job WHERE status = 'ACTIVE' AND contains(search_text, 'widget') AND currency = 'INR'
 AND salary_max >= 500000 AND ((experience_min IS NOT NULL AND experience_min < 5 AND
  CASE WHEN experience_max IS NULL THEN experience_min + 2 ELSE greatest(experience_max, experience_min + 1) END > 3)
  OR (experience_min IS NULL AND level = 'MID'))"""


@query(
    "P11_search_jobs",
    f"""WITH hit AS ({_SEARCH_SQL}),
 ranked AS (SELECT id, row_number() OVER (ORDER BY {_ORDER['recommended']}) AS pos FROM hit)
 SELECT r.id, r.pos, t.total, n.id AS next_cursor FROM ranked r, (SELECT count(*) AS total FROM hit) t,
 (SELECT max(CASE WHEN pos = 20 THEN id END) AS id, max(pos) AS m FROM ranked) n WHERE r.pos <= 20""",
)
def search_page(t):
    found = search.match_page(t.v_job, t.v_company, _SEARCH)
    return found.select("total", "next_cursor", F.posexplode("page").alias("pos", "id")).withColumn("pos", F.col("pos") + 1)


@query(
    "P12_jobs_by_ids",
    "SELECT id, status FROM v_job WHERE id IN ('job000000000002', 'job000000000005', 'job000000000006')",
)
def by_ids(t):
    wanted = ["job000000000002", "job000000000005", "nope!", "job000000000006", "job000000000002"]
    return P.jobs_by_ids(t.v_job, wanted).select("id", "status")


@query(
    "P13_parse_search_params",
    """SELECT event_id, event_type AS q, CASE WHEN event_type = 'view' THEN 'REMOTE' END AS remote,
 CASE WHEN user_id % 3 = 0 THEN 'SENIOR' END AS level,
 CASE WHEN user_id % 4 <> 1 THEN user_id * 1000 END AS min_salary,
 CASE WHEN user_id % 2 = 0 THEN 'newest' END AS sort FROM events""",
)
def params(t):
    raw = t.events.select(
        F.array(F.concat(F.lit("  "), "event_type", F.lit(" ")), F.lit("second")).alias("q"),
        F.when(F.col("event_type") == "view", "REMOTE").otherwise("remotely").alias("remote"),
        F.when(F.col("user_id") % 3 == 0, "SENIOR").otherwise("senior").alias("level"),
        F.when(F.col("user_id") % 4 == 1, "12x").otherwise((F.col("user_id") * 1000).cast("string")).alias("min_salary"),
        F.when(F.col("user_id") % 2 == 0, "newest").otherwise("recommended").alias("sort"),
        F.col("event_id"),
    )
    return P.parse_search_params(raw)


@query(
    "P14_listing_window",
    f"""SELECT id, posted_at < TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AS too_old,
 posted_at + INTERVAL '30' DAY AS expires_at, status IN ('ACTIVE', 'CLOSED', 'EXPIRED') AS is_public FROM v_job""",
)
def window_of_listing(t):
    cutoff = P.listing_cutoff(F.lit(AS_OF).cast("timestamp"))
    return t.v_job.select(
        "id",
        (F.col("posted_at") < cutoff).alias("too_old"),
        P.expires_at(F.col("posted_at")).alias("expires_at"),
        P.is_public().alias("is_public"),
    )


@query(
    "P17_admin_search",
    f"""SELECT j.id, j.title, coalesce(c.n, 0) AS clicks,
 j.posted_at + INTERVAL '30' DAY <= TIMESTAMP '{AS_OF}' + INTERVAL '7' DAY AS expires_soon
 FROM (SELECT * FROM v_job WHERE status = 'EXPIRED' AND contains(search_text, 'bolt')
  ORDER BY posted_at DESC, id DESC LIMIT 100) j
 LEFT JOIN (SELECT job_id, count(*) AS n FROM v_click GROUP BY job_id) c ON c.job_id = j.id""",
)
def admin_search(t):
    as_of = F.lit(AS_OF).cast("timestamp")
    top = t.v_job.filter((F.col("status") == "EXPIRED") & F.col("search_text").contains("bolt"))
    top = top.orderBy(F.desc("posted_at"), F.desc("id")).limit(100)
    clicks = t.v_click.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("clicks"))
    soon = P.expires_at(F.col("posted_at")) <= as_of + F.expr("INTERVAL '7' DAY")
    return top.join(clicks, "id", "left").select(
        "id", "title", F.coalesce("clicks", F.lit(0)).alias("clicks"), soon.alias("expires_soon")
    )


@query("P18_directory_filter", "SELECT id, name FROM v_company WHERE contains(lower(name), '#00000000')")
def directory(t):
    return t.v_company.filter(P.name_contains("  #00000000")).select("id", "name")


@query(
    "P19_active_filters",
    """SELECT user_id, concat_ws(',', 'city', CASE WHEN years_experience IS NOT NULL THEN 'exp' END,
 CASE WHEN expected_salary IS NOT NULL THEN 'min_salary' END) AS facets FROM v_candidate""",
)
def facets(t):
    rows = t.v_candidate.select(
        "user_id", "city", F.col("years_experience").isNotNull().alias("_e"), F.col("expected_salary").alias("min_salary")
    ).withColumn("exp", F.when(F.col("_e"), "any"))
    return rows.select("user_id", F.array_join(P.active_filters(rows, ["city", "exp", "min_salary"]), ",").alias("facets"))


# ------------------------------------------------------------------ orders


def _ordered(sort):
    return lambda t: t.v_job.orderBy(*O.order_by(sort)).select("id")


for _id, _sort in (("O1_order_recommended", "recommended"), ("O2_order_newest", "newest"), ("O3_order_salary", "salary")):
    query(_id, f"SELECT id FROM v_job ORDER BY {_ORDER[_sort]}")(_ordered(_sort))


@query(
    "O4_after_cursor",
    f"""WITH ranked AS (SELECT id, row_number() OVER (ORDER BY {_ORDER['salary']}) AS pos FROM v_job)
 SELECT id FROM ranked WHERE pos > (SELECT pos FROM ranked WHERE id = 'job000000000006')""",
)
def keyset(t):
    jobs = t.v_job
    return jobs.filter(O.after_cursor("salary", O.cursor_row(jobs, "job000000000006"))).select("id")


@query(
    "O6_home_recommended",
    "SELECT id, title FROM v_job WHERE status = 'ACTIVE' "
    "ORDER BY salary_disclosed DESC, featured DESC, posted_at DESC, id DESC LIMIT 6",
)
def home(t):
    return P.filter_active(t.v_job).orderBy(*O.order_by("home")).limit(6).select("id", "title")


# ------------------------------------------------------------------ joins


@query(
    "J1_job_company",
    "SELECT j.id, c.name AS company_name, c.industry FROM v_job j JOIN v_company c ON c.id = j.company_id",
)
def job_company(t):
    companies = t.v_company.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "industry")
    return t.v_job.join(companies, "company_id").select("id", "company_name", "industry")


@query(
    "J2_semi_exists",
    "SELECT id, name FROM v_company WHERE id IN (SELECT company_id FROM v_job WHERE status = 'ACTIVE')",
)
def semi(t):
    hiring = P.filter_active(t.v_job).select(F.col("company_id").alias("id"))
    return t.v_company.join(hiring, "id", "left_semi").select("id", "name")


@query(
    "J3_left_counts",
    """SELECT j.id, coalesce(c.n, 0) AS clicks, coalesce(a.n, 0) AS applications FROM v_job j
 LEFT JOIN (SELECT job_id, count(*) AS n FROM v_click GROUP BY job_id) c ON c.job_id = j.id
 LEFT JOIN (SELECT job_id, count(*) AS n FROM v_application GROUP BY job_id) a ON a.job_id = j.id""",
)
def left_counts(t):
    return pages.with_counts(t.v_job.select("id"), {"clicks": t.v_click, "applications": t.v_application})


@query("J4_anti", "SELECT id FROM v_job WHERE id NOT IN (SELECT job_id FROM v_application)")
def anti(t):
    return t.v_job.join(t.v_application.select(F.col("job_id").alias("id")), "id", "left_anti").select("id")


_BATCH = {
    "data-senior": SearchParams(discipline="DATA", level="SENIOR"),
    "rings-remote": SearchParams(q="ring", location="remote"),
    "fintech-paid": SearchParams(industry="FINTECH", min_salary=1_500_000),
    "design-early": SearchParams(discipline="DESIGN", exp="0-1"),
    "nation-3": SearchParams(location="nation_3", salary=True),
}


@query(
    "J7_search_batch",
    f"""WITH hit AS (
 SELECT j.*, s.search FROM v_job j JOIN v_company c ON c.id = j.company_id
 JOIN (SELECT * FROM (VALUES ('data-senior'), ('rings-remote'), ('fintech-paid'), ('design-early'), ('nation-3')) v(search)) s
  ON j.status = 'ACTIVE' AND CASE s.search
   WHEN 'data-senior' THEN j.discipline = 'DATA' AND j.level = 'SENIOR'
   WHEN 'rings-remote' THEN contains(j.search_text, 'ring') AND j.remote = 'REMOTE'
   WHEN 'fintech-paid' THEN c.industry = 'FINTECH' AND j.currency = 'INR' AND j.salary_max >= 1500000
   WHEN 'design-early' THEN j.discipline = 'DESIGN' AND CASE WHEN j.experience_min IS NULL
     THEN j.level IN ('INTERN', 'JUNIOR') ELSE j.experience_min < 1 END
   ELSE contains(lower(j.location), 'nation_3') AND j.salary_disclosed END),
 ranked AS (SELECT search, id, row_number() OVER (PARTITION BY search ORDER BY {_ORDER['recommended']}) AS pos,
  count(*) OVER (PARTITION BY search) AS total FROM hit)
 SELECT search, pos, id, total FROM ranked WHERE pos <= 20""",
)
def batch(t):
    jobs = t.v_job.withColumn("remote_region", F.lit(None).cast("string"))
    return search.search_batch(jobs, t.v_company, _BATCH)


# A saved search for every candidate, as query strings.
_SAVED_SQL = """SELECT user_id AS search_id, CASE user_id % 5 WHEN 0 THEN 'ring' WHEN 1 THEN 'promo  bolt' WHEN 2 THEN 'li' END AS q,
 CASE user_id % 7 WHEN 0 THEN 'nation_1' WHEN 1 THEN 'remote' END AS location, CASE WHEN user_id % 11 = 0 THEN 'HYBRID' END AS remote,
 CASE user_id % 4 WHEN 0 THEN 'DATA' WHEN 1 THEN 'DESIGN' END AS discipline, CASE user_id % 9 WHEN 0 THEN 'SENIOR' WHEN 1 THEN 'MID' WHEN 2 THEN 'INTERN' END AS level,
 CASE user_id % 13 WHEN 0 THEN '0-1' WHEN 1 THEN '3-5' WHEN 2 THEN '8-plus' END AS exp, CASE user_id % 6 WHEN 0 THEN 'FINTECH' WHEN 1 THEN 'SAAS' END AS industry,
 CASE WHEN user_id % 17 = 0 THEN 'USD' END AS currency, CASE WHEN user_id % 3 = 0 THEN (user_id % 40) * 50000 END AS min_salary,
 CASE WHEN user_id % 10 = 3 THEN 'PROMO' END AS tag, CASE WHEN user_id % 8 = 0 THEN '1' END AS salary,
 CASE user_id % 3 WHEN 1 THEN 'newest' WHEN 2 THEN 'salary' END AS sort,
 CASE WHEN user_id % 19 = 0 THEN 'job000000000006' END AS "cursor" FROM (SELECT c_custkey AS user_id FROM customer) u"""


@query(
    "J7_search_table",
    f"""WITH s AS ({_SAVED_SQL}), asked AS (SELECT search_id AS rep, * EXCLUDE (search_id) FROM s),
 j AS (SELECT v.*, c.industry, CASE currency WHEN 'INR' THEN 4 WHEN 'USD' THEN 3 WHEN 'GBP' THEN 2 WHEN 'EUR' THEN 1 END AS cur,
  CASE WHEN experience_min IS NOT NULL THEN experience_min ELSE CASE level WHEN 'INTERN' THEN 0 WHEN 'JUNIOR' THEN 0 WHEN 'MID' THEN 2 WHEN 'SENIOR' THEN 5
   WHEN 'PRINCIPAL' THEN 10 WHEN 'DIRECTOR' THEN 10 ELSE 8 END END AS e0,
  CASE WHEN experience_min IS NOT NULL THEN CASE WHEN experience_max IS NULL THEN experience_min + 2 ELSE greatest(experience_max, experience_min + 1) END
   ELSE CASE level WHEN 'INTERN' THEN 1 WHEN 'JUNIOR' THEN 2 WHEN 'MID' THEN 5 WHEN 'SENIOR' THEN 7 WHEN 'PRINCIPAL' THEN 12 WHEN 'DIRECTOR' THEN 12 ELSE 10 END END AS e1
  FROM v_job v JOIN v_company c ON c.id = v.company_id),
 hit AS (SELECT a.rep, a.sort, j.id, j.posted_at, CASE WHEN a.sort IS DISTINCT FROM 'newest' THEN j.salary_disclosed END AS k1,
   CASE WHEN a.sort = 'salary' THEN j.cur END AS k2, CASE WHEN a.sort = 'salary' THEN j.salary_max END AS k3, CASE WHEN a.sort = 'salary' THEN j.salary_min END AS k4, a."cursor" AS start
  FROM asked a JOIN j ON j.status = 'ACTIVE' AND (a.q IS NULL OR (a.q = 'promo  bolt' AND contains(j.search_text, 'promo') AND contains(j.search_text, 'bolt')) OR contains(j.search_text, a.q))
   AND (a.location IS NULL OR CASE a.location WHEN 'remote' THEN j.remote = 'REMOTE' ELSE contains(lower(j.location), a.location) END)
   AND (a.remote IS NULL OR j.remote = a.remote) AND (a.discipline IS NULL OR j.discipline = a.discipline) AND (a.level IS NULL OR j.level = a.level)
   AND (a.exp IS NULL OR (a.exp = '0-1' AND j.e0 < 1 AND j.e1 > 0) OR (a.exp = '3-5' AND j.e0 < 5 AND j.e1 > 3) OR (a.exp = '8-plus' AND j.e1 > 8))
   AND (a.industry IS NULL OR j.industry = a.industry) AND (a.currency IS NULL OR j.currency = a.currency)
   AND (coalesce(a.min_salary, 0) = 0 OR (j.currency = 'INR' AND j.salary_max >= a.min_salary)) AND (a.salary IS NULL OR j.salary_disclosed)
   AND (a.tag IS NULL OR j.id IN (SELECT job_id FROM v_job_tag WHERE tag = a.tag))),
 begun AS (SELECT a.rep, CASE WHEN a.sort IS DISTINCT FROM 'newest' THEN j.salary_disclosed END AS k1, CASE WHEN a.sort = 'salary' THEN j.cur END AS k2,
   CASE WHEN a.sort = 'salary' THEN j.salary_max END AS k3, CASE WHEN a.sort = 'salary' THEN j.salary_min END AS k4, j.posted_at, j.id FROM asked a JOIN j ON j.id = a."cursor"),
 both_ AS (SELECT h.*, begun.id IS NULL OR row(coalesce(h.k1, false), coalesce(h.k2, -1), coalesce(h.k3, -1), coalesce(h.k4, -1), h.posted_at, h.id)
   < row(coalesce(begun.k1, false), coalesce(begun.k2, -1), coalesce(begun.k3, -1), coalesce(begun.k4, -1), begun.posted_at, begun.id) AS here FROM hit h LEFT JOIN begun ON begun.rep = h.rep),
 ranked AS (SELECT rep, id, here, count(*) OVER (PARTITION BY rep) AS total, row_number() OVER (PARTITION BY rep, here
   ORDER BY k1 DESC NULLS LAST, k2 DESC NULLS LAST, k3 DESC NULLS LAST, k4 DESC NULLS LAST, posted_at DESC, id DESC) AS pos FROM both_)
 SELECT rep AS search_id, pos, id, total FROM ranked r WHERE r.here AND r.pos <= 20""",
)
def saved_searches(t):
    """Query strings are parsed (P13) and all of them answered from the job table together."""
    saved = t.sql(_SAVED_SQL.replace('"cursor"', "cursor"))
    raw = saved.select(*[F.col(c) if c == "search_id" else F.array(F.col(c).cast("string")).alias(c) for c in saved.columns])
    return search.search_table(t.job, t.v_company, P.parse_search_params(raw))


@query("J9_range_overlap", f"SELECT bucket, count(*) AS jobs FROM ({_BUCKET_SQL}) x GROUP BY bucket")
def range_overlap(t):
    """The same overlap read as a join to the bucket table, which is five fixed rows."""
    usual = F.create_map(*[F.lit(x) for lv, (a, b) in P.LEVEL_YEARS.items() for x in (lv, a)])
    usual_end = F.create_map(
        *[F.lit(x) for lv, (a, b) in P.LEVEL_YEARS.items() for x in (lv, a + P.OPEN_SPAN if b is None else b)]
    )
    stated = F.col("experience_min").isNotNull()
    asks = t.v_job.select(
        F.coalesce("experience_min", usual[F.col("level")]).alias("experience_min"),
        F.when(stated, F.col("experience_max")).otherwise(usual_end[F.col("level")]).alias("experience_max"),
    )
    counted = asks.groupBy("experience_min", "experience_max").agg(F.count(F.lit(1)).alias("n"))
    return pages.in_buckets(counted, P.BUCKETS).groupBy("bucket").agg(F.sum("n").alias("jobs"))


@query(
    "J11_application_detail",
    """SELECT a.user_id, a.job_id, a.stage, j.title, j.status, c.name AS company_name FROM v_application a
 JOIN v_job j ON j.id = a.job_id JOIN v_company c ON c.id = j.company_id""",
)
def application_detail(t):
    return pages.application_detail(t.v_application, t.v_job, t.v_company)


@query(
    "J12_company_jobs",
    f"""SELECT company_id, id, pos FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id
 ORDER BY {_ORDER['salary']}) AS pos FROM v_job WHERE status = 'ACTIVE') x WHERE pos <= 200""",
)
def company_jobs(t):
    return pages.company_jobs(t.v_job, "salary").select("company_id", "id", "pos")
