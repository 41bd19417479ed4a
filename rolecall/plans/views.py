"""Job-board shaped views over the test tables.

Each view is one SELECT that Spark and DuckDB both accept, so a query and its
oracle start from exactly the same rows. `Tables` gives them as DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.session import pin_clock

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str] = {
    "v_company": """
SELECT s_suppkey AS id, concat('company-', CAST(s_suppkey AS STRING)) AS slug, s_name AS name,
 CASE s_nationkey % 4 WHEN 0 THEN 'SAAS' WHEN 1 THEN 'FINTECH' WHEN 2 THEN 'ECOMMERCE' ELSE 'OTHER' END AS industry
FROM supplier""",
    "v_job": """
SELECT concat('job', lpad(CAST(k AS STRING), 12, '0')) AS id, company_id, title, location,
 lower(concat(title, ' ', company_name, ' ', location)) AS search_text,
 CASE k % 6 WHEN 0 THEN 'ENGINEERING' WHEN 1 THEN 'DESIGN' WHEN 2 THEN 'PRODUCT' WHEN 3 THEN 'DATA' WHEN 4 THEN 'SECURITY' ELSE 'INFRASTRUCTURE' END AS discipline,
 CASE o_custkey % 8 WHEN 0 THEN 'INTERN' WHEN 1 THEN 'JUNIOR' WHEN 2 THEN 'MID' WHEN 3 THEN 'SENIOR' WHEN 4 THEN 'STAFF' WHEN 5 THEN 'PRINCIPAL' WHEN 6 THEN 'MANAGER' ELSE 'DIRECTOR' END AS level,
 CASE k % 5 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' ELSE 'ONSITE' END AS remote,
 CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'EXPIRED' ELSE 'PENDING' END AS status,
 CASE k % 9 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'LEVER' ELSE 'GREENHOUSE' END AS source,
 k % 50 = 0 AS featured,
 k6 % 3 <> 0 AS salary_disclosed,
 CASE WHEN k6 % 3 <> 0 THEN tp * 10 END AS salary_min,
 CASE WHEN k6 % 3 <> 0 THEN tp * 10 + (k % 7) * 100000 END AS salary_max,
 CASE WHEN k6 % 3 <> 0 THEN CASE k18 % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'INR' END END AS currency,
 CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 12 AS INT) END AS experience_min,
 CASE WHEN k % 4 = 0 OR k % 3 = 1 THEN NULL ELSE CAST(k % 12 + k % 4 AS INT) END AS experience_max,
 TIMESTAMP '2023-12-17 00:00:00' + (k % 45) * INTERVAL '1' DAY AS posted_at,
 TIMESTAMP '2024-01-15 00:00:00' + (k % 16) * INTERVAL '1' DAY AS last_verified_at
FROM (
 SELECT o.o_orderkey AS k, w.company_id, s.s_name AS company_name, o.o_custkey, o.o_orderstatus,
  concat(p.p_name, ' ', lower(p.p_type)) AS title, n.n_name AS location,
  CAST(floor(o.o_totalprice) AS BIGINT) AS tp,
  CAST(floor(o.o_orderkey / 6) AS BIGINT) AS k6, CAST(floor(o.o_orderkey / 18) AS BIGINT) AS k18
 FROM orders o
 JOIN (SELECT l_orderkey, MIN(l_suppkey) AS company_id, MIN(l_partkey) AS part_id
       FROM lineitem GROUP BY l_orderkey) w ON w.l_orderkey = o.o_orderkey
 JOIN part p ON p.p_partkey = w.part_id JOIN supplier s ON s.s_suppkey = w.company_id
 JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey) base""",
    "v_job_tag": """
SELECT DISTINCT concat('job', lpad(CAST(l.l_orderkey AS STRING), 12, '0')) AS job_id, p.p_type AS tag
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_candidate": """
SELECT c.c_custkey AS user_id, n.n_name AS city,
 CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_custkey % 20 AS INT) END AS years_experience,
 CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 1000000 + (c.c_custkey % 30) * 100000 END AS expected_salary
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "v_candidate_skill": """
SELECT user_id, skill FROM (
 SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' ELSE 'MEDIUM' END AS skill FROM customer WHERE c_custkey % 7 <> 0
 UNION ALL
 SELECT c_custkey AS user_id, CASE c_custkey % 2 WHEN 0 THEN 'PROMO' ELSE 'LARGE' END AS skill FROM customer WHERE c_custkey % 7 <> 0) t""",
    "v_click": """
SELECT event_id, user_id, ts AS created_at,
 concat('job', lpad(replace(replace(props, '{"k": ', ''), '}', ''), 12, '0')) AS job_id
FROM events WHERE event_type = 'click'""",
    "v_application": """
SELECT user_id, job_id, MIN(ts) AS created_at, MAX(ts) AS last_clicked_at,
 CASE user_id % 5 WHEN 0 THEN 'APPLIED' WHEN 1 THEN 'INTERVIEWING' WHEN 2 THEN 'OFFER' WHEN 3 THEN 'REJECTED' ELSE 'GHOSTED' END AS stage
FROM (SELECT user_id, ts, concat('job', lpad(replace(replace(props, '{"k": ', ''), '}', ''), 12, '0')) AS job_id
 FROM events WHERE event_type = 'purchase') e
GROUP BY user_id, job_id""",
    "v_review": """
SELECT company_id, user_id, rating, status, created_at FROM (
 SELECT l.l_suppkey AS company_id, o.o_custkey AS user_id, CAST(floor(l.l_quantity) AS BIGINT) % 5 + 1 AS rating,
  CASE l.l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'REJECTED' ELSE 'PENDING' END AS status,
  l.l_shipdate AS created_at,
  ROW_NUMBER() OVER (PARTITION BY l.l_suppkey, o.o_custkey
   ORDER BY l.l_shipdate DESC, l.l_orderkey DESC, l.l_linenumber DESC, l.l_quantity DESC, l.l_returnflag) AS rn
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) t
WHERE rn = 1""",
    "v_member": """
SELECT c_custkey AS user_id, c_custkey % 37 AS company_id,
 CASE WHEN c_custkey % 5 = 0 THEN 'APPROVED' WHEN c_custkey % 5 = 1 THEN 'REJECTED' ELSE 'PENDING' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 30) * INTERVAL '1' DAY AS created_at
FROM customer
UNION ALL
SELECT c_custkey AS user_id, 37 + c_custkey % 41 AS company_id,
 CASE WHEN c_custkey % 6 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status,
 TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 29) * INTERVAL '1' DAY AS created_at
FROM customer WHERE c_custkey % 2 = 0""",
    "v_saved": """
SELECT user_id, job_id, MIN(created_at) AS created_at FROM (
 SELECT user_id, ts AS created_at, concat('job', lpad(replace(replace(props, '{"k": ', ''), '}', ''), 12, '0')) AS job_id
 FROM events WHERE event_type = 'view') e
GROUP BY user_id, job_id""",
    # Postings as a careers feed would carry them, rendered from the numbers a reader must recover.
    "v_posting": """
SELECT id AS external_id, company_id % 5 AS company_id, source, k, discipline, level, lo, hi, posted_at, workplace,
 experience_min, experience_max,
 CASE WHEN k % 13 = 0 THEN 'Marketing Lead' ELSE CASE level WHEN 'INTERN' THEN concat(role, ' Intern')
  WHEN 'JUNIOR' THEN concat('Junior  ', role) WHEN 'SENIOR' THEN concat('Sr. ', role) WHEN 'STAFF' THEN concat('Staff ', role)
  WHEN 'PRINCIPAL' THEN concat('Principal ', role) WHEN 'MANAGER' THEN concat(role, ' Manager')
  WHEN 'DIRECTOR' THEN concat('Director, ', role) ELSE role END END AS title,
 CASE k6 % 6 WHEN 0 THEN 'Bangalore, India' WHEN 1 THEN 'Hyderabad / Pune' WHEN 2 THEN 'Remote - India'
  WHEN 3 THEN 'Surat, Gujarat' WHEN 4 THEN 'London, UK' ELSE 'Gurgaon or New Delhi' END AS place,
 CASE WHEN k % 17 = 0 THEN 'ftp://jobs.example.com/1' ELSE concat('HTTPS://Jobs.Example.com/apply/', CAST(k AS STRING)) END AS apply_url,
 CASE WHEN discipline = 'DATA' THEN concat(' REQ-', level, ' ') END AS requisition_id,
 concat('We build tools for busy teams. ', CASE WHEN k % 10 = 0 THEN 'Pay is competitive'
   ELSE concat('CTC: ', CAST(lo AS STRING), ' - ', CAST(hi AS STRING), ' LPA') END, '. ',
  CASE WHEN experience_min IS NULL THEN '' WHEN experience_max IS NULL
   THEN concat('You need ', CAST(experience_min AS STRING), '+ years of experience. ')
   ELSE concat('You need ', CAST(experience_min AS STRING), '-', CAST(experience_max AS STRING), ' years of experience. ') END,
  'Stack: Kafka, Kafka, ', CASE k % 3 WHEN 0 THEN 'Python and Docker' WHEN 1 THEN 'React Native and React' ELSE 'Go, Rust and ASP.Net' END,
  '. You will join people who care about their craft and review work daily. Posting code ', CAST(k AS STRING), '.') AS description
FROM (
 SELECT *, 3 + k6 % 5 AS lo, 4 + k6 % 5 + k6 % 2 AS hi, CASE WHEN k % 7 <> 0 THEN remote END AS workplace,
  CASE discipline WHEN 'ENGINEERING' THEN 'Backend Developer' WHEN 'DESIGN' THEN 'UX Designer' WHEN 'PRODUCT' THEN 'Product Owner'
   WHEN 'DATA' THEN 'Data Analyst' WHEN 'SECURITY' THEN 'Security Analyst' ELSE 'DevOps Specialist' END AS role
 FROM (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k, CAST(floor(CAST(substr(id, 4) AS BIGINT) / 6) AS BIGINT) AS k6 FROM v_job) j0
) j1""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def _needed(sql: str) -> list[str]:
    """The views a text mentions, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str, leading: list[str] | None = None) -> str:
    """Put the CTEs a query text needs in front of it."""
    ctes = list(leading or []) + [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    if not ctes:
        return sql
    head = "WITH " + ",\n".join(ctes)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


class Tables:
    """Lazy access to one scale-factor folder: `t.orders`, `t.v_job`, `t.job` …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_clock(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = [n for n in BASE_TABLES if re.search(rf"\b{n}\b", with_views(text))]
        base = [f"{n} AS (SELECT * FROM parquet.`{self.sf_dir}/{n}.parquet`)" for n in used]
        return self.spark.sql(with_views(text, base))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def job(self) -> DataFrame:
        """v_job with its tags as an array, the shape the job table has."""
        tags = self.v_job_tag.groupBy(F.col("job_id").alias("id")).agg(
            F.sort_array(F.collect_list("tag")).alias("tags")
        )
        return self.v_job.join(tags, "id", "left").withColumn(
            "tags", F.coalesce("tags", F.array().cast("array<string>"))
        )

    @property
    def raw_posting(self) -> DataFrame:
        """v_posting in the shape a feed reader returns; Lever postings carry structured pay.

        The base tables are one small file each, which one task would read and go on
        with: the rows are dealt to all cores before any text rule runs.
        """
        pay = F.struct(
            (F.col("lo") * 100_000).cast("double").alias("min"),
            (F.col("hi") * 100_000).cast("double").alias("max"),
            F.lit("inr").alias("currency"),
            F.lit("per-year-salary").alias("interval"),
        )
        return self.v_posting.repartition(self.spark.sparkContext.defaultParallelism, "external_id").select(
            "company_id", "source", "external_id", "title", F.lit(None).cast("string").alias("department"),
            "description", "apply_url", "requisition_id", F.lit(None).cast("string").alias("classification"),
            "workplace", F.array("place").alias("locations"), "posted_at",
            F.when(F.col("source") == "LEVER", pay).alias("pay"),
        )

    @property
    def candidate(self) -> DataFrame:
        """v_candidate with skills as an array (null-free, sorted)."""
        skills = self.v_candidate_skill.groupBy("user_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
        return self.v_candidate.join(skills, "user_id", "left").withColumn(
            "skills", F.coalesce("skills", F.array().cast("array<string>"))
        )
