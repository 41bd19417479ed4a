"""Registered queries: feed readers (S operators).

The feeds are rendered from v_posting as the JSON each board sends and read back;
the oracle returns the numbers and texts that went in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.plans.views import AS_OF
from rolecall.session import scratch_path
from rolecall.sources import feeds


def _landed(rows, payload, schema, token="token", detail_key=None):
    """Responses rendered as JSON lines in the shared folder, read back as landed files.

    A list of jobs holds those of up to three postings; one line is no JSON at all.
    """
    spark = rows.sparkSession
    envelope = rows.select(
        F.col("company_id").cast("string").alias("company_id"),
        (F.lit(token) if isinstance(token, str) else token).alias("token"),
        F.lit(AS_OF).alias("fetched_at"),
        (detail_key if detail_key is not None else F.lit(None).cast("string")).alias("detail_key"),
        payload.alias("payload"),
        F.floor(F.col("k") / 3).alias("_line"),
    )
    first = envelope.schema["payload"].dataType.fields[0]
    if first.name in ("jobs", "jobPostings", "content"):
        keys = ["company_id", "token", "fetched_at", "detail_key"]
        jobs = envelope.groupBy(*keys, "_line").agg(F.flatten(F.collect_list(f"payload.{first.name}")).alias(first.name))
        envelope = jobs.select(*keys, F.struct(first.name).alias("payload"))
    lines = envelope.select(F.to_json(F.struct("company_id", "token", "fetched_at", "detail_key", "payload")).alias("value"))
    path = scratch_path(spark, "landed")
    lines.union(spark.createDataFrame([('{"company_id": "1", "payload',)], "value string")).write.text(path)
    return feeds.read_landed(spark, path, schema)


def _one(list_name, /, **fields):
    """A response whose list holds one job."""
    return F.struct(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])).alias(list_name))


def _html(t):
    return F.concat(F.lit("<div><p>"), F.regexp_replace("description", r"&", "&amp;"), F.lit("</p></div>"))


def _text(column):
    return column.cast("string")


_SHOWN = ["external_id", "title", "department", "description", "apply_url", "workplace", "posted_at", "requisition_id", "classification"]


def _show(df, *more):
    return df.select(*_SHOWN, F.array_join("locations", "|").alias("locations"), *more)




@query(
    "S1_feed_greenhouse",
    """SELECT CAST(k AS VARCHAR) AS external_id, title, discipline AS department, concat('## About us', chr(10), chr(10), description) AS description,
 apply_url, CAST(NULL AS VARCHAR) AS workplace, posted_at, CAST(k + 1 AS VARCHAR) AS requisition_id, CAST(NULL AS VARCHAR) AS classification,
 concat(place, '|HQ|', place) AS locations FROM v_posting""",
)
def greenhouse(t):
    rows = t.v_posting
    html = F.concat(F.lit("<h2> <b>About us</b> </h2>"), _html(t))
    encoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    day = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = _one(
        "jobs",
        id=F.col("k"),
        title=F.concat(F.lit(" "), "title"),
        absolute_url=F.col("apply_url"),
        updated_at=day,  # half the postings only say when they were updated
        first_published=F.when(F.col("k") % 2 == 0, day),
        location=F.struct(F.col("place").alias("name")),
        offices=F.array(F.struct(F.lit("HQ").alias("name"), F.col("place").alias("location"))),
        departments=F.array(F.struct(F.col("discipline").alias("name")), F.struct(F.lit("Other").alias("name"))),
        content=encoded,
        internal_job_id=F.col("k") + 1,
    )
    landed = _landed(rows, payload, feeds.GREENHOUSE)
    return _show(feeds.greenhouse_postings(landed))


@query(
    "S2_feed_lever",
    """SELECT external_id, title, discipline AS department, concat(description, chr(10), chr(10), '## Perks', chr(10), chr(10), '- Tea', chr(10), '- Bikes',
 chr(10), chr(10), 'Bye') AS description, apply_url, workplace, posted_at, CAST(NULL AS VARCHAR) AS requisition_id, 'Full-time' AS classification,
 place AS locations, lo * 100000 AS pay_min, hi * 100000 AS pay_max FROM v_posting""",
)
def lever(t):
    items = F.lit("<li>Tea</li><li>Bikes</li>")
    payload = _one(
        "jobs",
        id=F.col("external_id"),
        text=F.col("title"),
        hostedUrl=F.col("apply_url"),
        createdAt=F.unix_millis("posted_at"),
        workplaceType=F.lower("workplace"),
        categories=F.struct(F.col("place").alias("location"), F.col("discipline").alias("team"), F.lit("Full-time").alias("commitment")),
        description=_html(t),
        lists=F.array(F.struct(F.lit("Perks").alias("text"), items.alias("content"))),
        additional=F.lit("<p>Bye</p>"),
        salaryRange=F.struct(
            (F.col("lo") * 100000).alias("min"), (F.col("hi") * 100000).alias("max"), F.lit("INR").alias("currency"),
            F.lit("per-year-salary").alias("interval"),
        ),
    )
    found = feeds.lever_postings(_landed(t.v_posting, payload, feeds.LEVER))
    pay = [F.col("pay.min").cast("long").alias("pay_min"), F.col("pay.max").cast("long").alias("pay_max")]
    return _show(found, *pay)


@query(
    "S3_feed_ashby",
    """SELECT external_id, title, discipline AS department, description, apply_url, CASE WHEN k % 4 = 1 THEN 'REMOTE' ELSE workplace END AS workplace,
 posted_at, CAST(NULL AS VARCHAR) AS requisition_id, level AS classification, concat(place, '|Pune|Kochi, India') AS locations,
 CASE WHEN k % 3 <> 0 THEN lo * 100000 END AS pay_min FROM v_posting WHERE k % 5 <> 2""",
)
def ashby(t):
    k = F.col("k")
    component = F.struct(
        F.lit("Salary").alias("compensationType"), F.lit("1 YEAR").alias("interval"), F.lit("INR").alias("currencyCode"),
        F.when(k % 3 != 0, F.col("lo") * 100000).alias("minValue"), (F.col("hi") * 100000).alias("maxValue"),
    )
    bonus = F.struct(
        F.lit("Bonus").alias("compensationType"), F.lit("1 YEAR").alias("interval"), F.lit("INR").alias("currencyCode"),
        F.col("lo").alias("minValue"), F.col("hi").alias("maxValue"),
    )
    payload = _one(
        "jobs",
        id=F.col("external_id"),
        title=F.col("title"),
        jobUrl=F.col("apply_url"),
        publishedAt=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
        isListed=F.when(k % 5 == 2, False),
        isRemote=k % 4 == 1,
        workplaceType=F.when(k % 4 != 1, F.initcap("workplace")),
        department=F.col("discipline"),
        employmentType=F.col("level"),
        location=F.col("place"),
        secondaryLocations=F.array(F.struct(F.lit("Pune").alias("location")), F.struct(F.lit("").alias("location"))),
        address=F.struct(F.struct(F.lit("India").alias("addressCountry"), F.lit("Kochi").alias("addressLocality")).alias("postalAddress")),
        descriptionHtml=_html(t),
        compensation=F.struct(F.array(bonus, component).alias("summaryComponents")),
    )
    found = feeds.ashby_postings(_landed(t.v_posting, payload, feeds.ASHBY))
    return _show(found, F.col("pay.min").cast("long").alias("pay_min"))


_HOST = "acme.wd5.myworkdayjobs.com"


@query(
    "S4_feed_workday",
    f"""SELECT concat('acme/Careers/job/', CAST(k AS VARCHAR)) AS external_id, title, CAST(NULL AS VARCHAR) AS department,
 CASE WHEN k % 2 = 0 THEN description ELSE '' END AS description, concat('https://{_HOST}/Careers/job/', CAST(k AS VARCHAR)) AS apply_url,
 CASE WHEN k % 2 = 0 THEN workplace END AS workplace,
 CASE WHEN k % 4 = 0 THEN posted_at ELSE TIMESTAMP '{AS_OF}' - (k % 35) * INTERVAL '1' DAY END AS posted_at,
 concat('JR', CAST(100000 + k AS VARCHAR)) AS requisition_id, CAST(NULL AS VARCHAR) AS classification,
 concat(CASE WHEN k % 2 = 0 THEN 'Pune|India|' ELSE '' END, CASE WHEN k % 3 = 0 THEN '' ELSE concat(place, '|') END, 'India') AS locations,
 k % 2 = 0 AS detail_ready FROM v_posting WHERE k % 35 < 30""",
)
def workday(t):
    k, age = F.col("k"), F.col("k") % 35
    path = F.concat(F.lit("/job/"), k)
    posted = (
        F.when(age == 0, "Posted Today").when(age == 1, "Posted Yesterday").when(age < 30, F.concat(F.lit("Posted "), age, F.lit(" Days Ago")))
        .otherwise("Posted 30+ Days Ago")
    )
    listed = _one(
        "jobPostings",
        title=F.col("title"),
        externalPath=path,
        locationsText=F.when(k % 3 == 0, "3 Locations").otherwise(F.col("place")),
        postedOn=posted,
        bulletFields=F.array(F.lit("Full time"), F.concat(F.lit(" JR"), k + 100000, F.lit(" "))),
    )
    detail = F.struct(
        F.struct(
            _html(t).alias("jobDescription"), F.lit("Pune").alias("location"),
            F.when(k % 4 == 0, F.date_format("posted_at", "yyyy-MM-dd")).alias("startDate"), F.col("workplace").alias("remoteType"),
        ).alias("jobPostingInfo")
    )
    key = F.concat(F.lit("acme/Careers"), path)
    list_rows = feeds.workday_postings(_landed(t.v_posting, listed, feeds.WORKDAY, f"{_HOST}|acme|Careers"))
    details = feeds.workday_details(_landed(t.v_posting.filter(k % 2 == 0), detail, feeds.WORKDAY_DETAIL, detail_key=key))
    return _show(feeds.with_details(list_rows, details), "detail_ready")


@query(
    "S5_feed_smartrecruiters",
    """SELECT external_id, title, discipline AS department, concat('## Role', chr(10), chr(10), description) AS description,
 concat('https://jobs.smartrecruiters.com/Acme/', external_id) AS apply_url,
 CASE WHEN workplace IN ('REMOTE', 'HYBRID') THEN workplace END AS workplace, posted_at, CASE WHEN k % 2 = 0 THEN concat('REF', CAST(k AS VARCHAR)) END AS requisition_id,
 CASE WHEN k % 3 = 0 THEN 'Full-time / Mid' ELSE 'Full-time' END AS classification, concat(place, '|Pune|India') AS locations FROM v_posting""",
)
def smartrecruiters(t):
    k = F.col("k")
    listed = _one(
        "content",
        id=F.col("external_id"),
        name=F.col("title"),
        releasedDate=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        location=F.struct(
            F.lit("Pune").alias("city"), F.col("place").alias("fullLocation"), (F.col("workplace") == "REMOTE").alias("remote"),
            (F.col("workplace") == "HYBRID").alias("hybrid"),
        ),
        function=F.struct(F.col("discipline").alias("label")),
        refNumber=F.when(k % 2 == 0, F.concat(F.lit("REF"), k)).otherwise(""),
        typeOfEmployment=F.struct(F.lit("Full-time").alias("label")),
        experienceLevel=F.struct(F.when(k % 3 == 0, "Mid").alias("label")),
    )
    section = F.struct(F.lit("Role").alias("title"), _html(t).alias("text"))
    detail = F.struct(F.struct(F.create_map(F.lit("jobDescription"), section).alias("sections")).alias("jobAd"))
    key = F.concat(F.lit("Acme/"), "external_id")
    list_rows = feeds.smartrecruiters_postings(_landed(t.v_posting, listed, feeds.SMARTRECRUITERS, "Acme"))
    details = feeds.smartrecruiters_details(_landed(t.v_posting, detail, feeds.SMARTRECRUITERS_DETAIL, detail_key=key))
    return _show(feeds.with_details(list_rows, details))


@query(
    "S6_feed_eightfold",
    """SELECT concat('acme.com:', CAST(k AS VARCHAR)) AS external_id, title, discipline AS department, description,
 CASE WHEN k % 2 = 0 THEN concat('https://jobs.acme.com/p/', CAST(k AS VARCHAR)) ELSE concat('https://apply.acme.com/careers/job/', CAST(k AS VARCHAR)) END AS apply_url,
 workplace, posted_at, CAST(NULL AS VARCHAR) AS requisition_id, CAST(NULL AS VARCHAR) AS classification,
 concat(place, '|Pune, MH, IN|India') AS locations FROM v_posting""",
)
def eightfold(t):
    k = F.col("k")
    position = F.array(
        F.struct(
            k.alias("id"), F.col("title").alias("name"), F.array("place").alias("locations"),
            F.array(F.lit("Pune, MH, IN")).alias("standardizedLocations"), F.unix_seconds("posted_at").alias("postedTs"),
            F.col("discipline").alias("department"), F.lower("workplace").alias("workLocationOption"),
        )
    )
    detail = F.struct(
        F.struct(
            _html(t).alias("jobDescription"), F.when(k % 2 == 0, F.concat(F.lit("https://jobs.acme.com/p/"), k)).alias("publicUrl")
        ).alias("data")
    )
    key = F.concat(F.lit("acme.com:"), k)
    list_rows = feeds.eightfold_postings(
        _landed(t.v_posting, F.struct(F.struct(position.alias("positions")).alias("data")), feeds.EIGHTFOLD, "apply.acme.com|acme.com")
    )
    details = feeds.eightfold_details(_landed(t.v_posting, detail, feeds.EIGHTFOLD_DETAIL, detail_key=key))
    return _show(feeds.with_details(list_rows, details))


@query(
    "S7_feed_oracle",
    """SELECT concat('acme.fa.oraclecloud.com:', CAST(k AS VARCHAR)) AS external_id, title, CAST(NULL AS VARCHAR) AS department,
 concat(description, chr(10), chr(10), 'You own it.') AS description,
 concat('https://acme.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/', CAST(k AS VARCHAR)) AS apply_url,
 workplace, posted_at, CAST(NULL AS VARCHAR) AS requisition_id, CAST(NULL AS VARCHAR) AS classification,
 concat(place, '|Noida, India|India') AS locations FROM v_posting""",
)
def oracle(t):
    k = F.col("k")
    requisition = F.struct(
        _text(k).alias("Id"), F.col("title").alias("Title"), F.date_format("posted_at", "yyyy-MM-dd").alias("PostedDate"),
        F.col("place").alias("PrimaryLocation"), F.initcap("workplace").alias("WorkplaceType"),
        F.array(F.struct(F.lit("Noida, India").alias("Name"))).alias("secondaryLocations"),
    )
    listed = F.struct(F.array(F.struct(F.array(requisition).alias("requisitionList"))).alias("items"))
    detail = F.struct(
        F.array(
            F.struct(_html(t).alias("ExternalDescriptionStr"), F.lit("<p>You own it.</p>").alias("ExternalResponsibilitiesStr"))
        ).alias("items")
    )
    host = "acme.fa.oraclecloud.com"
    list_rows = feeds.oracle_postings(_landed(t.v_posting, listed, feeds.ORACLE, f"{host}|CX_1|300000000000001"))
    details = feeds.oracle_details(_landed(t.v_posting, detail, feeds.ORACLE_DETAIL, detail_key=F.concat(F.lit(f"{host}:"), k)))
    return _show(feeds.with_details(list_rows, details))


@query(
    "S8_feed_amazon",
    """SELECT external_id, title, discipline AS department, concat(description, chr(10), chr(10), '## Basic qualifications', chr(10), chr(10), '5 things') AS description,
 concat('https://www.amazon.jobs/en/jobs/', CAST(k AS VARCHAR)) AS apply_url, CAST(NULL AS VARCHAR) AS workplace, posted_at,
 CAST(NULL AS VARCHAR) AS requisition_id, CAST(NULL AS VARCHAR) AS classification, concat(place, '|India') AS locations
 FROM v_posting WHERE k % 8 <> 3""",
)
def amazon(t):
    k = F.col("k")
    payload = _one(
        "jobs",
        id_icims=F.col("external_id"),
        title=F.col("title"),
        job_path=F.concat(F.lit("/en/jobs/"), k),
        # One in eight carries no readable date and is dropped.
        posted_date=F.when(k % 8 == 3, "soon").otherwise(F.date_format("posted_at", "MMMM d, yyyy")),
        normalized_location=F.col("place"),
        job_category=F.col("discipline"),
        description=_html(t),
        basic_qualifications=F.lit("5 things<br/>"),
        preferred_qualifications=F.lit(""),
    )
    return _show(feeds.amazon_postings(_landed(t.v_posting, payload, feeds.AMAZON, "IND")))


@query(
    "S13_workday_india_facet",
    """SELECT s_suppkey AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'locationCountry' WHEN s_suppkey % 3 = 1 THEN 'locations' ELSE 'offices' END AS parameter,
 CASE WHEN s_suppkey % 3 = 0 THEN concat('c', CAST(s_suppkey AS VARCHAR)) WHEN s_suppkey % 3 = 1 THEN 'l1,l2' ELSE 'o1,o2,o3' END AS ids FROM supplier""",
)
def facet(t):
    k = F.col("s_suppkey")

    def values(*pairs):
        return F.array(*[F.struct(d.alias("descriptor"), i.alias("id")) for d, i in pairs])

    def leaf(param, vals):
        return F.struct(
            F.lit(param).alias("facetParameter"),
            F.transform(vals, lambda v: F.struct(v["descriptor"].alias("descriptor"), v["id"].alias("id"),
                                                 F.lit(None).cast("string").alias("facetParameter"),
                                                 F.lit(None).cast("array<struct<descriptor:string,id:string>>").alias("values"))).alias("values"),
        )

    country = values((F.when(k % 3 == 0, " India ").otherwise("Germany"), F.concat(F.lit("c"), k)), (F.lit("Japan"), F.lit("c0")))
    towns = values((F.lit("IN - Hyderabad"), F.lit("l1")), (F.lit("Berlin"), F.lit("l9")), (F.lit("Pune"), F.lit("l2")))
    offices = values((F.when(k % 3 == 2, "Noida 1").otherwise("Oslo"), F.lit("o1")), (F.lit("IND Tower"), F.lit("o2")),
                     (F.when(k % 3 == 2, "Kochi").otherwise("Rome"), F.lit("o3")))

    def branch(param, vals):
        return F.struct(F.lit(param).alias("descriptor"), F.lit(param).alias("id"), F.lit(param).alias("facetParameter"), vals.alias("values"))

    nested = F.struct(F.lit("locationMainGroup").alias("facetParameter"), F.array(branch("locationCountry", country), branch("locations", towns)).alias("values"))
    payload = F.struct(F.array(leaf("jobFamily", values((F.lit("Engineering"), F.lit("e")))), nested, leaf("offices", offices)).alias("facets"))
    kind = f"struct<{feeds._as_struct(feeds.WORKDAY_FACETS)}>"
    sites = t.supplier.select(k.alias("site"), F.from_json(F.to_json(payload), kind).alias("payload"))
    return feeds.workday_india_facet(sites, "site").select("site", "parameter", F.array_join("ids", ",").alias("ids"))


@query(
    "S16_validate_token",
    """SELECT p_partkey AS id, p_partkey % 4 <> 0 AS valid, CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 2 ELSE 1 END AS tokens FROM part""",
)
def tokens(t):
    k = F.col("p_partkey") % 4
    source = F.when(k < 2, "LEVER").when(k == 2, "WORKDAY").otherwise("AMAZON")
    text = (
        F.when(k == 0, F.concat(F.lit("board"), F.col("p_partkey"), F.lit(" not|ok")))
        .when(k == 1, F.concat(F.lit(" board_"), F.col("p_partkey"), F.lit("  other.board ")))
        .when(k == 2, F.lit("acme.wd5.myworkdayjobs.com|acme|Site-1"))
        .otherwise("IND")
    )
    return t.part.select(
        F.col("p_partkey").alias("id"), feeds.valid_tokens(source, text).alias("valid"), F.size(feeds.split_tokens(text)).alias("tokens")
    )
