"""Registered queries: postings to listings, merging, and the feed diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.functions import classify
from rolecall.functions.display_text import truncate_words
from rolecall.functions.text import word_set
from rolecall.operators.components import connected_components
from rolecall.operators.similarity import similar_links
from rolecall.plans import dedupe, ingest
from rolecall.plans.views import AS_OF

# What a reader must find in v_posting, written without any text matching.
LISTED_SQL = f"""
SELECT external_id, company_id, source, k, replace(title, '  ', ' ') AS title, discipline, level, posted_at,
 CASE WHEN level = 'INTERN' THEN 'INTERNSHIP' ELSE 'FULL_TIME' END AS employment_type,
 CASE k % 3 WHEN 0 THEN 'Kafka,Python,Docker' WHEN 1 THEN 'Kafka,React,React Native' ELSE 'Kafka,Go,Rust,.NET' END AS tags,
 CASE place WHEN 'Bangalore, India' THEN 'Bengaluru' WHEN 'Hyderabad / Pune' THEN 'Hyderabad · Pune'
  WHEN 'Remote - India' THEN 'India' WHEN 'Surat, Gujarat' THEN 'Surat' ELSE 'Gurugram · Delhi' END AS location,
 CASE WHEN place = 'Remote - India' OR workplace = 'REMOTE' THEN 'REMOTE' WHEN workplace = 'HYBRID' THEN 'HYBRID' ELSE 'ONSITE' END AS remote,
 CASE WHEN source = 'LEVER' OR k % 10 <> 0 THEN lo * 100000 END AS salary_min,
 CASE WHEN source = 'LEVER' OR k % 10 <> 0 THEN hi * 100000 END AS salary_max,
 experience_min, experience_max, concat('https://jobs.example.com/apply/', CAST(k AS STRING)) AS apply_url
FROM v_posting WHERE posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND place <> 'London, UK' AND k % 13 <> 0 AND k % 17 <> 0"""


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(
    "P15_normalize_posting",
    f"""SELECT external_id, company_id, source, title, discipline, level, employment_type, tags, location, remote,
 CASE WHEN remote = 'REMOTE' THEN 'India' END AS remote_region, salary_min, salary_max, experience_min, experience_max,
 apply_url, posted_at FROM ({LISTED_SQL}) x""",
)
def normalize(t):
    listed = ingest.normalize_postings(t.raw_posting, as_of())
    return listed.drop("description", "role", "content_hash").withColumn("tags", F.array_join("tags", ","))


@query(
    "F6_extract_tags",
    """SELECT external_id, CASE k % 3 WHEN 0 THEN 'Kafka,Python,Docker' WHEN 1 THEN 'Kafka,React,React Native' ELSE 'Kafka,Go,Rust,.NET' END AS tags
 FROM v_posting""",
)
def tags(t):
    found = classify.extract_tags(F.col("title"), F.col("description"))
    return t.raw_posting.select("external_id", F.array_join(found, ",").alias("tags"))


_CUT = "substr(c, 1, 159)"
_SPACE = f"length({_CUT}) - instr(reverse({_CUT}), ' ')"


@query(
    "F23_truncate",
    f"""SELECT doc_id, CASE WHEN length(c) <= 160 THEN c ELSE concat(regexp_replace(CASE WHEN contains({_CUT}, ' ') AND {_SPACE} > 96
  THEN substr(c, 1, {_SPACE}) ELSE {_CUT} END, '[\\s,.;:·(–—-]+$', ''), '…') END AS summary
 FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents) d""",
)
def summaries(t):
    return t.documents.select("doc_id", truncate_words(F.col("text"), 160).alias("summary"))


@query(
    "A13_skip_profile",
    f"""WITH j AS (SELECT company_id, CASE WHEN posted_at < TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY THEN 'too_old'
  WHEN place = 'London, UK' THEN 'not_india' WHEN k % 13 = 0 THEN 'not_in_scope' WHEN k % 17 = 0 THEN 'bad_url'
  ELSE 'listed' END AS outcome FROM v_posting)
 SELECT company_id, count(*) FILTER (WHERE outcome = 'too_old') AS too_old,
  count(*) FILTER (WHERE outcome = 'not_india') AS not_india, count(*) FILTER (WHERE outcome = 'not_in_scope') AS not_in_scope,
  count(*) FILTER (WHERE outcome = 'bad_url') AS bad_url, count(*) FILTER (WHERE outcome = 'listed') AS listed
 FROM j GROUP BY company_id""",
)
def skips(t):
    return ingest.skip_profile(t.raw_posting, as_of())


MERGED_SQL = f"""
 WITH l AS (SELECT *, CASE WHEN discipline = 'DATA' THEN concat_ws('|', company_id, source, title) ELSE
   concat_ws('|', company_id, source, title, remote, coalesce(salary_min, 0), coalesce(salary_max, 0),
    coalesce(experience_min, -1), coalesce(experience_max, -1), k % 3) END AS grp FROM ({LISTED_SQL}) x),
 c AS (SELECT grp, external_id, unnest(string_split(location, ' · ')) AS city, unnest(range(1, 4)) AS p FROM l),
 f AS (SELECT grp, city, min(concat(external_id, CAST(p AS VARCHAR))) AS at_ FROM c
  WHERE city IS NOT NULL AND city <> 'India' GROUP BY grp, city),
 r AS (SELECT grp, city, at_, row_number() OVER (PARTITION BY grp ORDER BY at_) AS n FROM f),
 m AS (SELECT grp, string_agg(city, ' · ' ORDER BY n) AS location FROM r GROUP BY grp),
 g AS (SELECT grp, min(external_id) AS external_id, min(company_id) AS company_id, min(source) AS source,
  min(posted_at) AS posted_at, count(*) AS group_size FROM l GROUP BY grp)
 SELECT g.external_id, g.company_id, g.source, coalesce(m.location, 'India') AS location, g.posted_at, g.group_size
 FROM g LEFT JOIN m ON m.grp = g.grp"""


@query("L3_dedupe_postings", MERGED_SQL)
def merged(t):
    listings = ingest.normalize_postings(t.raw_posting, as_of())
    return dedupe.dedupe_postings(listings).select(
        "external_id", "company_id", "source", "location", "posted_at", "group_size"
    )


@query(
    "L3_text_components",
    """WITH RECURSIVE w AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#]{2,}'))) AS w
  FROM documents),
 n AS (SELECT doc_id, lang, count(*) AS n FROM w GROUP BY doc_id, lang),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM w a JOIN w b ON a.lang = b.lang AND a.w = b.w
  AND a.doc_id < b.doc_id GROUP BY 1, 2),
 edge AS (SELECT p.x, p.y FROM pairs p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y
  WHERE p.shared * 10 >= (a.n + b.n - p.shared) * 9),
 both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
 reach AS (SELECT x AS node, x AS seen FROM both_ways UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.seen)
 SELECT node AS doc_id, min(seen) AS root FROM reach GROUP BY node""",
)
def text_components(t):
    """Near copies among the documents of one language, closed transitively."""
    sets = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("block"), word_set(F.col("text")).alias("words"))
    roots = connected_components(similar_links(sets), "x", "y")
    return roots.select(F.col("node").alias("doc_id"), "root")

