"""Registered queries: exports, imports and display columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.functions import display_text
from rolecall.functions.text import html_to_text, printable
from rolecall.operators import pages
from rolecall.plans.views import AS_OF
from rolecall.session import scratch_path
from rolecall.sources import exports

_BASE = "https://jobs.example.com"


@query(
    "S14_csv_import",
    """SELECT k AS row_number, CASE WHEN k % 6 = 0 THEN 'company_slug: unknown' WHEN k % 6 = 1 THEN 'salary_max: below the minimum'
 WHEN k % 6 = 2 THEN 'title: too short; level: invalid' ELSE '' END AS errors,
 CASE WHEN k % 6 = 0 THEN NULL ELSE company_id END AS company_id, CASE WHEN k % 6 = 4 THEN NULL ELSE lo * 100000 END AS salary_min,
 CASE WHEN k % 2 = 0 THEN 'Kafka,Go' ELSE 'SQL' END AS tags FROM v_posting""",
)
def csv_import(t):
    """Every posting as the text cells of a sheet row, checked against the company table."""
    k, band = F.col("k"), (F.col("lo") * 100000).cast("string")
    cells = t.v_posting.select(
        k.cast("int").alias("row_number"),
        F.when(k % 6 == 0, "nobody").otherwise(F.concat(F.lit("company-"), "company_id")).alias("company_slug"),
        F.when(k % 6 == 2, "x").otherwise(F.concat(F.lit("  "), "title")).alias("title"),
        "description",
        F.lower("discipline").alias("discipline"),
        F.when(k % 6 == 2, "boss").otherwise(F.lower("level")).alias("level"),
        F.when(k % 2 == 0, "Kafka; Go;Kafka").otherwise(" SQL ,").alias("tags"),
        F.lit("Pune").alias("location"),
        F.lit("onsite").alias("remote"),
        F.lit("").alias("remote_region"),
        F.when(k % 6 == 4, "").otherwise(band).alias("salary_min"),
        F.when(k % 6 == 4, "").when(k % 6 == 1, "100").otherwise(F.concat(band, F.lit(".0"))).alias("salary_max"),
        F.lit("2").alias("experience_min"),
        F.lit("").alias("experience_max"),
        F.lit("https://jobs.example.com/1").alias("apply_url"),
    )
    checked = exports.check_import(cells, t.v_company)
    return checked.select(
        "row_number", F.array_join("errors", "; ").alias("errors"), "company_id", "salary_min", F.array_join("tags", ",").alias("tags")
    )


@query(
    "S14_import_sheet",
    """WITH c AS (SELECT id, name, row_number() OVER (ORDER BY id) + 1 AS n, concat('Data Engineer, ', id) AS title FROM v_company)
 SELECT n AS row_number, id AS company_id, title, concat('Line one, "quoted"', chr(10), 'for ', name, ' and all of us here') AS description,
  concat('data-engineer-', id, '-', lower(replace(name, '#', '-')), '-', substr(sha1(concat(id, '|', title, '|', n)), 1, 6)) AS slug,
  CASE WHEN id % 3 = 0 THEN NULL ELSE 900000 + id END AS salary_min, id % 3 <> 0 AS salary_disclosed, 0 AS errors FROM c""",
)
def import_sheet(t):
    """One job of every company through a written sheet: quoted line breaks, blank rows, an odd header; read, checked, imported."""
    path = scratch_path(t.spark, "sheet")
    pay = F.when(F.col("id") % 3 != 0, (F.col("id") + 900_000).cast("string")).otherwise("")
    cells = t.v_company.select(
        "id",
        F.col("slug").alias("Company_Slug"),
        F.concat(F.lit(" Data Engineer, "), "id").alias("title"),
        F.concat(F.lit('Line one, "quoted"\nfor '), "name", F.lit(" and all of us here")).alias("DESCRIPTION"),
        *[F.lit(v).alias(k) for k, v in {"discipline": "data", "level": "mid", "tags": "SQL;Kafka", "location": "Pune", "remote": "onsite", "remote_region": ""}.items()],
        pay.alias("salary_min"),
        pay.alias("salary_max"),
        *[F.lit(v).alias(k) for k, v in {"experience_min": "", "experience_max": "", "apply_url": "https://jobs.example.com/1"}.items()],
    )
    cells.orderBy("id").drop("id").coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    found = exports.import_jobs(exports.read_import(t.spark, path), t.v_company)
    errors = found.errors.agg(F.count(F.lit(1)).alias("errors"))
    return found.rows.select("row_number", "company_id", "title", "description", "slug", "salary_min", "salary_disclosed").join(F.broadcast(errors))


@query(
    "S17_sitemap_export",
    f"""SELECT 'company' AS section, concat('{_BASE}/companies/', slug) AS url, CAST(NULL AS TIMESTAMP) AS updated_at FROM v_company
 UNION ALL SELECT 'job', concat('{_BASE}/jobs/', id), last_verified_at FROM v_job WHERE status = 'ACTIVE'
 UNION ALL SELECT 'page', concat('{_BASE}', p), NULL FROM (SELECT * FROM (VALUES ('/'), ('/jobs'), ('/companies'), ('/salaries'), ('/about'),
  ('/editorial-standards'), ('/privacy'), ('/terms'), ('/contact'), ('/employers/pricing'), ('/employers/verification')) v(p)) y""",
)
def sitemap(t):
    companies = t.v_company.withColumn("updated_at", F.lit(None).cast("timestamp"))
    return exports.sitemap(t.v_job.withColumn("slug", F.col("id")), companies, _BASE)


@query(
    "S18_job_jsonld",
    """SELECT id, title, CASE WHEN remote = 'REMOTE' THEN 'TELECOMMUTE' END AS telecommute,
 CASE WHEN remote <> 'REMOTE' THEN location END AS locality, CASE WHEN salary_disclosed THEN salary_max END AS top_pay,
 CASE WHEN experience_min = 0 THEN 'no requirements' END AS fresher, CASE WHEN experience_min > 0 THEN experience_min * 12 END AS months,
 strftime(posted_at + INTERVAL '30' DAY, '%Y-%m-%dT%H:%M:%S.000Z') AS valid_through, false AS closes_script FROM v_job""",
)
def jsonld(t):
    jobs = t.v_job.select(
        "*", F.lit("Uses <b>Spark</b>").alias("description"), F.lit("FULL_TIME").alias("employment_type"), F.col("id").alias("slug")
    )
    companies = t.v_company.withColumn("website", F.lit("https://example.com"))
    rendered = exports.job_jsonld(jobs, companies, _BASE)

    def read(path):
        return F.get_json_object("json", path)

    experience = read("$.experienceRequirements")
    return rendered.select(
        "id",
        read("$.title").alias("title"),
        read("$.jobLocationType").alias("telecommute"),
        read("$.jobLocation.address.addressLocality").alias("locality"),
        read("$.baseSalary.value.maxValue").cast("long").alias("top_pay"),
        F.when(experience == "no requirements", experience).alias("fresher"),
        read("$.experienceRequirements.monthsOfExperience").cast("int").alias("months"),
        read("$.validThrough").alias("valid_through"),
        F.contains("json", F.lit("<")).alias("closes_script"),
    )


@query(
    "S19_resume_json_read",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Engineer' END AS headline,
 CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 0 ELSE 2 END AS roles,
 CASE WHEN c_custkey % 4 IN (0, 1) THEN '' ELSE concat('Built ', c_mktsegment, '|Ran it') END AS bullets,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Go,SQL' END AS skills FROM customer""",
)
def resumes(t):
    k = F.col("c_custkey") % 4

    def role(name, bullets):
        return F.struct(name.alias("role"), F.lit("Acme ").alias("company"), bullets.alias("bullets"))

    lines = F.array(F.concat(F.lit(" Built "), "c_mktsegment"), F.lit(" "), F.lit("Ran it"))
    sections = F.to_json(F.array(role(F.lit("Dev"), lines), role(F.lit("Lead"), F.array().cast("array<string>"))))
    # A quarter hold a role title beyond the limit, a quarter broken JSON.
    too_long = F.to_json(F.array(role(F.repeat(F.lit("x"), 200), lines)))
    empty = F.lit("[]")
    stored = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.lit(" Engineer ").alias("headline"),
        F.lit("").alias("summary"),
        F.array(F.lit("Go"), F.lit(" go"), F.lit("SQL"), F.lit("")).alias("skills"),
        F.when(k == 0, too_long).when(k == 1, "{not json").otherwise(sections).alias("experience"),
        empty.alias("projects"),
        F.lit(None).cast("string").alias("education"),
        empty.alias("certifications"),
    )
    bullets = F.array_join(F.flatten(F.transform("experience", lambda e: e["bullets"])), "|")
    return exports.read_resumes(stored).select(
        "user_id", "headline", F.size("experience").alias("roles"), bullets.alias("bullets"), F.array_join("skills", ",").alias("skills")
    )


@query(
    "S20_resume_file_audit",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'not_a_pdf' END AS reason,
 concat('cv ', CAST(doc_id AS VARCHAR), '.pdf') AS filename FROM documents""",
)
def files(t):
    """Documents as uploaded bytes: a fifth empty, a fifth without the file signature."""
    k = F.col("doc_id") % 5
    body = F.when(k == 0, "").when(k == 1, F.concat(F.lit("x"), "text")).otherwise(F.concat(F.lit("%PDF-1.7 "), "text"))
    stored = t.documents.select(
        "doc_id",
        F.concat(F.lit("C:\\up/"), F.lit("cv  "), "doc_id", F.when(k < 3, ".PDF").otherwise("")).alias("path"),
        F.encode(body, "UTF-8").alias("content"),
    ).withColumn("length", F.octet_length("content"))
    audited = exports.audit_files(stored)
    return audited.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "reason", "filename")


_CARD_SQL = f"""SELECT id, CASE WHEN currency IS NULL THEN NULL WHEN currency <> 'INR' THEN
  CASE WHEN salary_min = salary_max THEN concat(CASE currency WHEN 'GBP' THEN '£' ELSE 'US$' END, format('{{:,}}', salary_min))
   ELSE concat(CASE currency WHEN 'GBP' THEN '£' ELSE 'US$' END, format('{{:,}}', salary_min), ' – ',
    CASE currency WHEN 'GBP' THEN '£' ELSE 'US$' END, format('{{:,}}', salary_max)) END
  WHEN lo = hi THEN concat('₹', lo, ' LPA') ELSE concat('₹', lo, '–', hi, ' LPA') END AS pay,
 CASE WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN concat(days, ' days ago') WHEN days < 14 THEN '1 week ago'
  WHEN days < 35 THEN concat(days // 7, ' weeks ago') WHEN days < 60 THEN '1 month ago' ELSE concat(days // 30, ' months ago') END AS posted,
 CASE WHEN days = 0 THEN 'Today' WHEN days < 7 THEN concat(days, 'd') ELSE concat(days // 7, 'w') END AS age,
 CASE remote WHEN 'REMOTE' THEN concat('Remote (India) · ', location) WHEN 'HYBRID' THEN concat('Hybrid · ', location) ELSE location END AS place,
 CASE WHEN experience_min IS NULL THEN NULL WHEN experience_max IS NULL THEN concat(experience_min, '+ yrs')
  WHEN experience_max = experience_min THEN concat(experience_min, CASE WHEN experience_min = 1 THEN ' yr' ELSE ' yrs' END)
  ELSE concat(experience_min, '–', experience_max, CASE WHEN experience_max = 1 THEN ' yr' ELSE ' yrs' END) END AS years
 FROM (SELECT *, CAST(date_diff('day', posted_at, TIMESTAMP '{AS_OF}') AS BIGINT) AS days,
  CASE WHEN CAST(floor(salary_min / 10000.0 + 0.5) AS BIGINT) % 10 = 0 THEN CAST(CAST(floor(salary_min / 10000.0 + 0.5) AS BIGINT) // 10 AS VARCHAR)
   ELSE concat(CAST(floor(salary_min / 10000.0 + 0.5) AS BIGINT) // 10, '.', CAST(floor(salary_min / 10000.0 + 0.5) AS BIGINT) % 10) END AS lo,
  CASE WHEN CAST(floor(salary_max / 10000.0 + 0.5) AS BIGINT) % 10 = 0 THEN CAST(CAST(floor(salary_max / 10000.0 + 0.5) AS BIGINT) // 10 AS VARCHAR)
   ELSE concat(CAST(floor(salary_max / 10000.0 + 0.5) AS BIGINT) // 10, '.', CAST(floor(salary_max / 10000.0 + 0.5) AS BIGINT) % 10) END AS hi
  FROM v_job) j"""


@query("P1_card_text", _CARD_SQL)
def card_text(t):
    as_of = F.lit(AS_OF).cast("timestamp")
    return t.v_job.select(
        "id",
        display_text.format_salary_band(F.col("salary_min"), F.col("salary_max"), F.col("currency")).alias("pay"),
        display_text.format_posted_ago(F.col("posted_at"), as_of).alias("posted"),
        display_text.format_age(F.col("posted_at"), as_of).alias("age"),
        display_text.format_location(F.col("location"), F.col("remote"), F.lit("India")).alias("place"),
        display_text.format_experience(F.col("experience_min"), F.col("experience_max")).alias("years"),
    )


@query(
    "F23_card_summaries",
    f"""SELECT concat('job ', j.id) AS key, j.title AS name, concat(j.title, ' at ', c.name, ': ', CASE WHEN t.pay IS NULL THEN '' ELSE concat(t.pay, ', ') END, t.place,
  CASE WHEN j.status = 'ACTIVE' THEN '' ELSE ' (no longer open)' END, '. On Board.') AS alt FROM ({_CARD_SQL}) t JOIN v_job j ON j.id = t.id JOIN v_company c ON c.id = j.company_id
 UNION ALL SELECT concat('company ', c.id), c.name, concat(c.name, ' on Board. ', CASE WHEN count(j.id) = 0 THEN 'No open roles right now'
  WHEN count(j.id) = 1 THEN '1 open role' ELSE concat(format('{{:,}}', count(j.id)), ' open roles') END, '.')
  FROM v_company c LEFT JOIN v_job j ON j.company_id = c.id AND j.status = 'ACTIVE' GROUP BY c.id, c.name""",
)
def card_summaries(t):
    firms = t.v_company.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    pay = display_text.format_salary_band(F.col("salary_min"), F.col("salary_max"), F.col("currency"))
    place = display_text.format_location(F.col("location"), F.col("remote"), F.lit("India"))
    jobs = t.v_job.join(firms, "company_id").select("id", display_text.job_summary(F.col("title"), F.col("company"), place, pay, F.col("status"), "Board").alias("s"))
    open_roles = t.v_job.filter("status = 'ACTIVE'").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    companies = firms.join(open_roles, "company_id", "left").select("company_id", display_text.company_summary(F.col("company"), F.coalesce("n", F.lit(0)), "Board").alias("s"))
    return jobs.select(F.concat(F.lit("job "), "id").alias("key"), F.col("s.title").alias("name"), "s.alt").unionByName(
        companies.select(F.concat(F.lit("company "), "company_id").alias("key"), F.col("s.name").alias("name"), "s.alt")
    )


_TYPED = "José’s “CV” – ₹18 LPA… → ﬁne½ 日本\t"
_SAME_PRINT = "–—−‘’‚“”„•·\t\u00a0", "---" + "''" * 3 + '"' * 3 + "--  "


@query(
    "F31_printable",
    f"""SELECT doc_id, regexp_replace(strip_accents(translate(replace(replace(replace(replace(replace(concat('{_TYPED}', text),
  '…', '...'), '→', '->'), '₹', 'Rs '), 'ﬁ', 'fi'), '½', '12'), '{_SAME_PRINT[0]}', '{_SAME_PRINT[1]}')), '[^\\x20-\\x7E]', '', 'g') AS line FROM documents""",
)
def printable_lines(t):
    return t.documents.select("doc_id", printable(F.concat(F.lit(_TYPED), "text")).alias("line"))


_TAGS = "(p|div|ul|ol|section|table|tr|blockquote)"


@query(
    "F10_html_to_text",
    rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS s FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(s, '(?i)<br\s*/?>', chr(10), 'g'), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', chr(10) || '## \1' || chr(10) || chr(10), 'g') AS s FROM a),
 c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)</{_TAGS}>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS s FROM b),
 d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(s, '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS s FROM c),
 e AS (SELECT page_id, regexp_replace(regexp_replace(replace(s, chr(160), ' '), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g') AS s FROM d),
 f AS (SELECT page_id, regexp_replace(regexp_replace(s, '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS s FROM e)
 SELECT page_id, s AS text FROM f""",
)
def page_text(t):
    return t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@query(
    "F32_description_headings",
    r"""WITH d AS (SELECT conv_id, turn, unnest(string_split(concat('## ', role, chr(10), 'Turn ', CAST(turn AS VARCHAR), ':', chr(10),
  '- not this:', chr(10), 'Is it? Yes:', chr(10), text), chr(10))) AS line FROM conversations),
 h AS (SELECT conv_id, turn, CASE WHEN line LIKE '## %' THEN trim(substr(line, 4)) WHEN line LIKE '- %' OR length(line) > 60 OR line NOT LIKE '%:' THEN ''
  WHEN regexp_matches(line, '[.!?]') OR length(regexp_replace(trim(line), '\S+', 'x', 'g')) > 15 THEN '' ELSE trim(substr(line, 1, length(line) - 1)) END AS heading FROM d)
 SELECT conv_id, turn, heading FROM h WHERE heading <> ''""",
)
def headings(t):
    document = F.concat(
        F.lit("## "), "role", F.lit("\nTurn "), F.col("turn").cast("string"), F.lit(":\n- not this:\nIs it? Yes:\n"), "text"
    )
    found = F.array_compact(F.transform(F.split(document, "\n"), display_text.heading_text))
    return t.conversations.select("conv_id", "turn", F.explode(found).alias("heading"))


@query(
    "F35_company_logo",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'https://x.in/logo.png' WHEN id % 2 = 0 THEN concat('/logos/', slug, '.webp') END AS logo FROM v_company""",
)
def logos(t):
    companies = t.v_company.withColumn("logo_url", F.when(F.col("id") % 3 == 0, "https://x.in/logo.png"))
    manifest = t.v_company.filter(F.col("id") % 2 == 0).select("slug")
    return pages.company_logos(companies, manifest).select("id", "logo")
