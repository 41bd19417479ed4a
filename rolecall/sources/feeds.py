"""Careers-feed snapshots to raw postings.

A snapshot is landed as JSON lines, one API response per line in an envelope:
`{"company_id", "token", "fetched_at", "payload": {...}}`. Every reader has an
explicit schema and two entry points: `read_<source>(spark, path)` for landed
files and `<source>_postings(df)` for a DataFrame that already has the envelope.

Search-style sources list roles without their text. Their details land on their
own and are joined by `with_details`; `list_only` and `detail_ready` tell the
sync which rows came without text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.text import decode_entities, html_to_text

RAW_COLUMNS = [
    "company_id", "source", "external_id", "title", "department", "description", "apply_url", "requisition_id",
    "classification", "workplace", "locations", "posted_at", "pay", "list_only", "detail_ready", "detail_key",
]
PAY_TYPE = "struct<min:double,max:double,currency:string,interval:string>"
MAX_AGE_DAYS = 30

# Payload schemas.
GREENHOUSE = (
    "jobs array<struct<id:bigint,title:string,absolute_url:string,updated_at:string,first_published:string,"
    "location:struct<name:string>,offices:array<struct<name:string,location:string>>,"
    "departments:array<struct<name:string>>,content:string,internal_job_id:bigint>>"
)
LEVER = (
    "jobs array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,"
    "categories:struct<location:string,allLocations:array<string>,team:string,department:string,commitment:string>,"
    "description:string,lists:array<struct<text:string,content:string>>,additional:string,"
    f"salaryRange:{PAY_TYPE}>>"
)
ASHBY = (
    "jobs array<struct<id:string,title:string,jobUrl:string,publishedAt:string,isListed:boolean,isRemote:boolean,"
    "workplaceType:string,department:string,employmentType:string,location:string,"
    "secondaryLocations:array<struct<location:string>>,"
    "address:struct<postalAddress:struct<addressCountry:string,addressLocality:string>>,descriptionHtml:string,"
    "compensation:struct<summaryComponents:array<struct<compensationType:string,interval:string,currencyCode:string,"
    "minValue:double,maxValue:double>>>>>"
)
WORKDAY = (
    "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,"
    "bulletFields:array<string>>>"
)
WORKDAY_DETAIL = (
    "jobPostingInfo struct<jobDescription:string,location:string,additionalLocations:array<string>,startDate:string,"
    "externalUrl:string,remoteType:string>"
)
WORKDAY_FACETS = (
    "facets array<struct<facetParameter:string,values:array<struct<descriptor:string,id:string,facetParameter:string,"
    "values:array<struct<descriptor:string,id:string>>>>>>"
)
SMARTRECRUITERS = (
    "content array<struct<id:string,name:string,releasedDate:string,"
    "location:struct<city:string,region:string,fullLocation:string,remote:boolean,hybrid:boolean>,"
    "department:struct<label:string>,`function`:struct<label:string>,refNumber:string,"
    "typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>>"
)
SMARTRECRUITERS_DETAIL = "postingUrl string, jobAd struct<sections:map<string,struct<title:string,text:string>>>"
EIGHTFOLD = (
    "data struct<positions:array<struct<id:bigint,name:string,locations:array<string>,standardizedLocations:array<string>,"
    "postedTs:bigint,department:string,workLocationOption:string,positionUrl:string>>>"
)
EIGHTFOLD_DETAIL = "data struct<jobDescription:string,publicUrl:string>"
ORACLE = (
    "items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,"
    "WorkplaceType:string,secondaryLocations:array<struct<Name:string>>>>>>"
)
ORACLE_DETAIL = (
    "items array<struct<ExternalDescriptionStr:string,ExternalResponsibilitiesStr:string,"
    "ExternalQualificationsStr:string>>"
)
AMAZON = (
    "jobs array<struct<id_icims:string,title:string,job_path:string,posted_date:string,normalized_location:string,"
    "location:string,city:string,job_category:string,description:string,basic_qualifications:string,"
    "preferred_qualifications:string>>"
)


def envelope(payload: str) -> str:
    return f"company_id string, token string, fetched_at timestamp, detail_key string, payload struct<{_as_struct(payload)}>"


def _as_struct(ddl: str) -> str:
    """`name type, name type` as struct fields, leaving nested commas alone."""
    fields, depth, start = [], 0, 0
    for i, char in enumerate(ddl + ","):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            fields.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(fields)


def read_landed(spark: SparkSession, path: str, payload: str) -> DataFrame:
    return spark.read.schema(envelope(payload)).json(path)


# ------------------------------------------------------------------ shared column rules

_DATE_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MM/dd/yyyy", "d MMM yyyy HH:mm:ss z"]


def parse_feed_date(value: Column) -> Column:
    """A date written as text; null when it is not one."""
    read = F.try_to_timestamp(value)
    plain = F.regexp_replace(value, r"^\s*[A-Z][a-z]{2,8}, (?=\d)", "")
    for form in _DATE_FORMATS:
        read = F.coalesce(read, F.try_to_timestamp(plain, F.lit(form)))
    return read


def parse_feed_epoch(value: Column) -> Column:
    """A number below 10^12 is in seconds, one above in milliseconds."""
    return F.when(value < 10**12, F.timestamp_seconds(value)).otherwise(F.timestamp_millis(value))


def workplace_of(text: Column) -> Column:
    return (
        F.when(text.rlike("(?i)remote"), "REMOTE")
        .when(text.rlike("(?i)hybrid|flex"), "HYBRID")
        .when(text.rlike("(?i)on-?site|office"), "ONSITE")
    )


def workday_age_days(posted: Column) -> Column:
    """Days in "Posted 3 Days Ago"; null for "30+ Days" and anything unreadable."""
    days = F.regexp_extract(posted, r"(?i)(\d+)\s+days?", 1)
    return (
        F.when(posted.rlike("(?i)today"), 0)
        .when(posted.rlike("(?i)yesterday"), 1)
        .when(posted.contains("+"), F.lit(None).cast("int"))
        .when(days != "", days.cast("int"))
    )


_REQUISITION = r"(?i)^[A-Z]{0,4}[-_]?\d{4,}(?:[-_][A-Z0-9]+)*$"


def workday_requisition(bullets: Column) -> Column:
    trimmed = F.transform(bullets, lambda b: F.trim(b))
    return F.try_element_at(F.filter(trimmed, lambda b: b.rlike(_REQUISITION)), F.lit(1))


def _present(*values: Column) -> Column:
    """The non-empty values, in order."""
    return F.filter(F.array(*values), lambda v: v.isNotNull() & (v != ""))


def _strings(array: Column) -> Column:
    return F.coalesce(F.filter(array, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def _with_india(locations: Column) -> Column:
    """A search limited to India: the location says so even when its text does not."""
    return F.concat(locations, F.array(F.lit("India")))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _token_part(n: int) -> Column:
    return F.try_element_at(F.split("token", r"\|"), F.lit(n))


def _raw(jobs: DataFrame, source: str, list_only: bool = False, **columns: Column) -> DataFrame:
    """Raw postings in the common shape; undated ones are dropped rather than taken for new."""
    defaults = {
        "department": "string", "requisition_id": "string", "classification": "string", "workplace": "string",
        "pay": PAY_TYPE, "detail_key": "string",
    }
    columns = {
        "source": F.lit(source),
        "list_only": F.lit(list_only),
        "detail_ready": F.lit(not list_only),
        "company_id": F.col("company_id"),
        **columns,
    }
    shaped = [
        columns[name].alias(name) if name in columns else F.lit(None).cast(defaults[name]).alias(name) for name in RAW_COLUMNS
    ]
    return jobs.select(*shaped).filter(F.col("posted_at").isNotNull())


# ------------------------------------------------------------------ sources with the text in the list

def greenhouse_postings(df: DataFrame) -> DataFrame:
    jobs = df.select("company_id", F.explode("payload.jobs").alias("j"))
    offices = F.flatten(F.transform("j.offices", lambda o: F.array(o["name"], o["location"])))
    return _raw(
        jobs,
        "GREENHOUSE",
        external_id=F.col("j.id").cast("string"),
        title=F.trim("j.title"),
        locations=F.concat(_present(F.col("j.location.name")), _strings(offices)),
        department=F.try_element_at(F.col("j.departments"), F.lit(1))["name"],
        # The board encodes its HTML once more for transport.
        description=html_to_text(decode_entities(_text(F.col("j.content")))),
        apply_url=F.col("j.absolute_url"),
        posted_at=parse_feed_date(F.coalesce("j.first_published", "j.updated_at")),
        requisition_id=F.col("j.internal_job_id").cast("string"),
    )


def lever_postings(df: DataFrame) -> DataFrame:
    jobs = df.select("company_id", F.explode("payload.jobs").alias("j"))
    lists = F.transform("j.lists", lambda x: F.concat(F.lit("<h3>"), x["text"], F.lit("</h3><ul>"), x["content"], F.lit("</ul>")))
    html = F.concat(_text(F.col("j.description")), _text(F.array_join(lists, "")), _text(F.col("j.additional")))
    return _raw(
        jobs,
        "LEVER",
        external_id=F.col("j.id"),
        title=F.trim("j.text"),
        locations=F.concat(_present(F.col("j.categories.location")), _strings(F.col("j.categories.allLocations"))),
        workplace=workplace_of(F.col("j.workplaceType")),
        department=F.coalesce("j.categories.department", "j.categories.team"),
        description=html_to_text(html),
        apply_url=F.col("j.hostedUrl"),
        posted_at=parse_feed_epoch(F.col("j.createdAt")),
        pay=F.col("j.salaryRange"),
        classification=F.col("j.categories.commitment"),
    )


def ashby_postings(df: DataFrame) -> DataFrame:
    jobs = df.select("company_id", F.explode("payload.jobs").alias("j")).filter(F.coalesce("j.isListed", F.lit(True)))
    complete = F.filter(
        "j.compensation.summaryComponents",
        lambda c: (c["compensationType"] == "Salary")
        & c["minValue"].isNotNull()
        & c["maxValue"].isNotNull()
        & (_text(c["currencyCode"]) != ""),
    )
    salary = F.try_element_at(complete, F.lit(1))
    pay = F.struct(
        salary["minValue"].alias("min"),
        salary["maxValue"].alias("max"),
        salary["currencyCode"].alias("currency"),
        salary["interval"].alias("interval"),
    )
    address = F.col("j.address.postalAddress")
    town = F.array_join(_present(address["addressLocality"], address["addressCountry"]), ", ")
    others = F.transform("j.secondaryLocations", lambda s: s["location"])
    return _raw(
        jobs,
        "ASHBY",
        external_id=F.col("j.id"),
        title=F.trim("j.title"),
        locations=F.concat(_present(F.col("j.location")), _strings(others), _present(town)),
        workplace=F.coalesce(workplace_of(F.col("j.workplaceType")), F.when(F.col("j.isRemote"), "REMOTE")),
        department=F.col("j.department"),
        description=html_to_text(_text(F.col("j.descriptionHtml"))),
        apply_url=F.col("j.jobUrl"),
        posted_at=parse_feed_date(F.col("j.publishedAt")),
        pay=F.when(salary.isNotNull(), pay),
        classification=F.col("j.employmentType"),
    )


def amazon_postings(df: DataFrame) -> DataFrame:
    jobs = df.select("company_id", F.explode("payload.jobs").alias("j"))

    def section(heading: str, name: str) -> Column:
        return F.when(_text(F.col(name)) != "", F.concat(F.lit(f"<h3>{heading}</h3>"), F.col(name))).otherwise("")

    html = F.concat(
        _text(F.col("j.description")),
        section("Basic qualifications", "j.basic_qualifications"),
        section("Preferred qualifications", "j.preferred_qualifications"),
    )
    return _raw(
        jobs,
        "AMAZON",
        external_id=F.col("j.id_icims"),
        title=F.trim("j.title"),
        locations=_with_india(_present(F.col("j.normalized_location"), F.col("j.city"))),
        department=F.col("j.job_category"),
        description=html_to_text(html),
        apply_url=F.concat(F.lit("https://www.amazon.jobs"), F.col("j.job_path")),
        posted_at=parse_feed_date(F.col("j.posted_date")),
    )


# ------------------------------------------------------------------ search-style sources

def workday_postings(df: DataFrame) -> DataFrame:
    host, tenant, site = _token_part(1), _token_part(2), _token_part(3)
    jobs = df.select("company_id", "token", "fetched_at", F.explode("payload.jobPostings").alias("j"))
    age = workday_age_days(F.col("j.postedOn"))
    recent = jobs.withColumn("_age", age).filter(F.col("_age") < MAX_AGE_DAYS)
    vague = F.col("j.locationsText").rlike(r"(?i)^\d+ locations?$")
    base = F.when(host.contains("myworkdaysite.com"), F.concat_ws("/", host, F.lit("recruiting"), tenant, site)).otherwise(
        F.concat_ws("/", host, site)
    )
    key = F.concat(tenant, F.lit("/"), site, F.col("j.externalPath"))
    return _raw(
        recent,
        "WORKDAY",
        list_only=True,
        external_id=key,
        detail_key=key,
        title=F.trim("j.title"),
        locations=_with_india(_present(F.when(~F.coalesce(vague, F.lit(False)), F.col("j.locationsText")))),
        description=F.lit(""),
        apply_url=F.concat(F.lit("https://"), base, F.col("j.externalPath")),
        posted_at=F.col("fetched_at") - F.make_dt_interval(F.col("_age")),
        requisition_id=workday_requisition(F.col("j.bulletFields")),
    )


def workday_details(df: DataFrame) -> DataFrame:
    d = F.col("payload.jobPostingInfo")
    return df.select(
        "detail_key",
        html_to_text(_text(d["jobDescription"])).alias("description"),
        _with_india(F.concat(_present(d["location"]), _strings(d["additionalLocations"]))).alias("locations"),
        workplace_of(d["remoteType"]).alias("workplace"),
        parse_feed_date(d["startDate"]).alias("posted_at"),
        F.when(d["externalUrl"] != "", d["externalUrl"]).alias("apply_url"),
    )


def smartrecruiters_postings(df: DataFrame) -> DataFrame:
    jobs = df.select("company_id", "token", F.explode("payload.content").alias("j"))
    kind = F.array_join(_present(F.col("j.typeOfEmployment.label"), F.col("j.experienceLevel.label")), " / ")
    return _raw(
        jobs,
        "SMARTRECRUITERS",
        list_only=True,
        external_id=F.col("j.id"),
        detail_key=F.concat_ws("/", "token", "j.id"),
        title=F.trim("j.name"),
        locations=_with_india(_present(F.col("j.location.fullLocation"), F.col("j.location.city"))),
        workplace=F.when(F.col("j.location.remote"), "REMOTE").when(F.col("j.location.hybrid"), "HYBRID"),
        department=F.coalesce("j.department.label", "j.function.label"),
        description=F.lit(""),
        apply_url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), F.col("j.id")),
        posted_at=parse_feed_date(F.col("j.releasedDate")),
        requisition_id=F.when(F.col("j.refNumber") != "", F.col("j.refNumber")),
        classification=F.when(kind != "", kind),
    )


def smartrecruiters_details(df: DataFrame) -> DataFrame:
    def section(s: Column) -> Column:
        heading = F.when(_text(s["title"]) != "", F.concat(F.lit("<h3>"), s["title"], F.lit("</h3>"))).otherwise("")
        return F.concat(heading, _text(s["text"]))

    html = _text(F.array_join(F.transform(F.map_values("payload.jobAd.sections"), section), ""))
    url = F.col("payload.postingUrl")
    return df.select("detail_key", html_to_text(html).alias("description"), F.when(url != "", url).alias("apply_url"))


def eightfold_postings(df: DataFrame) -> DataFrame:
    host, domain = _token_part(1), _token_part(2)
    jobs = df.select("company_id", "token", F.explode("payload.data.positions").alias("j"))
    key = F.concat(domain, F.lit(":"), F.col("j.id"))
    path = F.coalesce("j.positionUrl", F.concat(F.lit("/careers/job/"), F.col("j.id")))
    return _raw(
        jobs,
        "EIGHTFOLD",
        list_only=True,
        external_id=key,
        detail_key=key,
        title=F.trim("j.name"),
        locations=_with_india(F.concat(_strings(F.col("j.locations")), _strings(F.col("j.standardizedLocations")))),
        workplace=workplace_of(F.col("j.workLocationOption")),
        department=F.col("j.department"),
        description=F.lit(""),
        apply_url=F.concat(F.lit("https://"), host, path),
        posted_at=parse_feed_epoch(F.col("j.postedTs")),
    )


def eightfold_details(df: DataFrame) -> DataFrame:
    url = F.col("payload.data.publicUrl")
    return df.select(
        "detail_key",
        html_to_text(_text(F.col("payload.data.jobDescription"))).alias("description"),
        F.when(url != "", url).alias("apply_url"),
    )


def oracle_postings(df: DataFrame) -> DataFrame:
    host, site = _token_part(1), _token_part(2)
    first = F.try_element_at(F.col("payload.items"), F.lit(1))
    jobs = df.select("company_id", "token", F.explode(first["requisitionList"]).alias("j"))
    key = F.concat(host, F.lit(":"), F.col("j.Id"))
    others = F.transform("j.secondaryLocations", lambda s: s["Name"])
    return _raw(
        jobs,
        "ORACLE",
        list_only=True,
        external_id=key,
        detail_key=key,
        title=F.trim("j.Title"),
        locations=_with_india(F.concat(_present(F.col("j.PrimaryLocation")), _strings(others))),
        workplace=workplace_of(F.col("j.WorkplaceType")),
        description=F.lit(""),
        apply_url=F.concat(
            F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), F.col("j.Id")
        ),
        posted_at=parse_feed_date(F.col("j.PostedDate")),
    )


def oracle_details(df: DataFrame) -> DataFrame:
    d = F.try_element_at(F.col("payload.items"), F.lit(1))
    parts = [d["ExternalDescriptionStr"], d["ExternalResponsibilitiesStr"], d["ExternalQualificationsStr"]]
    return df.select("detail_key", html_to_text(F.concat_ws("", *parts)).alias("description"))


def with_details(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Listed roles completed by the details that have landed for them.

    A detail's fields replace the listed ones where it has them; its places come
    before the listed ones, so both count. Rows without a detail keep `detail_ready`
    false.
    """
    fields = [c for c in details.columns if c != "detail_key"]
    d = details.select("detail_key", F.struct(*fields).alias("_d"))
    joined = listed.join(d, "detail_key", "left")
    found = F.col("_d").isNotNull()
    columns = []
    for name in listed.columns:
        if name == "detail_ready":
            columns.append((found | F.col(name)).alias(name))
        elif name == "locations" and name in fields:
            columns.append(F.when(found, F.concat(F.col("_d.locations"), F.col(name))).otherwise(F.col(name)).alias(name))
        elif name in fields:
            columns.append(F.coalesce(f"_d.{name}", name).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns)


def read_greenhouse(spark: SparkSession, path: str) -> DataFrame:
    return greenhouse_postings(read_landed(spark, path, GREENHOUSE))


def read_lever(spark: SparkSession, path: str) -> DataFrame:
    return lever_postings(read_landed(spark, path, LEVER))


def read_ashby(spark: SparkSession, path: str) -> DataFrame:
    return ashby_postings(read_landed(spark, path, ASHBY))


def read_amazon(spark: SparkSession, path: str) -> DataFrame:
    return amazon_postings(read_landed(spark, path, AMAZON))


def read_workday(spark: SparkSession, path: str, details: str) -> DataFrame:
    return with_details(
        workday_postings(read_landed(spark, path, WORKDAY)), workday_details(read_landed(spark, details, WORKDAY_DETAIL))
    )


def read_smartrecruiters(spark: SparkSession, path: str, details: str) -> DataFrame:
    return with_details(
        smartrecruiters_postings(read_landed(spark, path, SMARTRECRUITERS)),
        smartrecruiters_details(read_landed(spark, details, SMARTRECRUITERS_DETAIL)),
    )


def read_eightfold(spark: SparkSession, path: str, details: str) -> DataFrame:
    return with_details(
        eightfold_postings(read_landed(spark, path, EIGHTFOLD)), eightfold_details(read_landed(spark, details, EIGHTFOLD_DETAIL))
    )


def read_oracle(spark: SparkSession, path: str, details: str) -> DataFrame:
    return with_details(oracle_postings(read_landed(spark, path, ORACLE)), oracle_details(read_landed(spark, details, ORACLE_DETAIL)))


# ------------------------------------------------------------------ Workday facets and board tokens

_INDIA_FACET = (
    r"(?i)\bindia\b|(?-i:\bIND\b)|\bIN\s*-|bengaluru|bangalore|hyderabad|pune|gurugram|gurgaon|noida|mumbai|chennai|"
    r"kolkata|ahmedabad|delhi|coimbatore|kochi|jaipur|vadodara|mohali|thiruvananthapuram"
)


def workday_india_facet(sites: DataFrame, key: str) -> DataFrame:
    """(key, parameter, ids): the filter that limits a site's search to India.

    A value that is the country wins; else the parameter with most Indian values,
    the first met on a tie.
    """

    def groups(facet: Column) -> Column:
        nested = F.transform(
            facet["values"], lambda v: F.struct(v["facetParameter"].alias("parameter"), v["values"].alias("values"))
        )
        leaf = F.struct(
            facet["facetParameter"].alias("parameter"),
            F.transform(facet["values"], lambda v: F.struct(v["descriptor"].alias("descriptor"), v["id"].alias("id"))).alias("values"),
        )
        return F.when(F.try_element_at(facet["values"], F.lit(1))["values"].isNotNull(), nested).otherwise(F.array(leaf))

    flat = sites.select(key, F.posexplode(F.flatten(F.transform("payload.facets", groups))).alias("g", "f"))
    values = flat.select(key, "g", "f.parameter", F.posexplode("f.values").alias("v", "x"))
    label = F.trim(_text(F.col("x.descriptor")))
    rated = values.select(
        key, "parameter", F.struct("g", "v").alias("at"), F.col("x.id").alias("id"),
        label.rlike("(?i)^india$").alias("country"), label.rlike(_INDIA_FACET).alias("indian"),
    ).filter("indian")
    counted = rated.groupBy(key, "parameter").agg(
        F.count_if(~F.col("country")).alias("n"),
        F.min("at").alias("first"),
        F.transform(
            F.sort_array(F.collect_list(F.when(~F.col("country"), F.struct("at", "id")))), lambda s: s["id"]
        ).alias("partial"),
        F.min(F.when(F.col("country"), F.struct("at", "id"))).alias("whole"),
    )
    ids = F.when(F.col("whole").isNotNull(), F.array("whole.id")).otherwise(F.col("partial"))
    # A country value sorts before any count; counts sort from the largest.
    rank = F.struct(
        F.coalesce(F.col("whole.at"), F.struct(F.lit(2**31 - 1).alias("g"), F.lit(0).alias("v"))).alias("c"),
        (-F.col("n")).alias("n"),
        "first",
    )
    return counted.groupBy(key).agg(F.min_by(F.struct("parameter", ids.alias("ids")), rank).alias("b")).select(
        key, "b.parameter", "b.ids"
    )


# What a board token of each source looks like.
TOKEN_PATTERNS = {
    "GREENHOUSE": r"(?i)^[a-z0-9_.-]{1,80}$",
    "LEVER": r"(?i)^[a-z0-9_.-]{1,80}$",
    "ASHBY": r"(?i)^[a-z0-9_.-]{1,80}$",
    "WORKDAY": r"(?i)^[a-z0-9.-]+\.(myworkdayjobs|myworkdaysite)\.com\|[a-z0-9_-]+\|[a-z0-9_-]+$",
    "SMARTRECRUITERS": r"(?i)^[a-z0-9_.-]{1,80}$",
    "EIGHTFOLD": r"(?i)^[a-z0-9.-]+\.[a-z]{2,}\|[a-z0-9.-]+\.[a-z]{2,}$",
    "ORACLE": r"(?i)^[a-z0-9.-]+\.oraclecloud\.com\|[a-z0-9_]+\|\d+$",
    "AMAZON": r"^[A-Z]{3}$",
}


def split_tokens(tokens: Column) -> Column:
    return F.filter(F.split(tokens, r"\s+"), lambda t: t != "")


def valid_tokens(source: Column, tokens: Column) -> Column:
    """Whether there is a token and every one has its source's form."""
    parts = split_tokens(_text(tokens))
    condition = F.lit(False)
    for name, pattern in TOKEN_PATTERNS.items():
        condition = F.when(source == name, (F.size(parts) > 0) & F.forall(parts, _has_form(pattern))).otherwise(condition)
    return condition


def _has_form(pattern: str):
    return lambda token: token.rlike(pattern)
