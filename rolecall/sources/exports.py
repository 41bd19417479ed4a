"""Files in and out: CSV import, sitemap, structured data, stored resume JSON, resume file audit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.text import search_text, slugify
from rolecall.operators.filters import expires_at, is_active
from rolecall.operators.quality import clean_job_input, job_errors
from rolecall.operators.sets import distinct_ignoring_case

SITEMAP_FILE = 45_000
# Pages that always exist.
STATIC_PATHS = [
    "/", "/jobs", "/companies", "/salaries", "/about", "/editorial-standards", "/privacy", "/terms", "/contact",
    "/employers/pricing", "/employers/verification",
]


def sitemap(jobs: DataFrame, companies: DataFrame, base: str) -> DataFrame:
    """(section, url, last_modified): fixed pages, every company, every active job."""
    spark = jobs.sparkSession
    pages = spark.createDataFrame([("page", base + p) for p in STATIC_PATHS], "section string, url string")
    firms = companies.select(F.lit("company").alias("section"), F.concat(F.lit(f"{base}/companies/"), "slug").alias("url"), "updated_at")
    roles = jobs.filter(is_active()).select(F.lit("job").alias("section"), F.concat(F.lit(f"{base}/jobs/"), "slug").alias("url"), F.col("last_verified_at").alias("updated_at"))
    return pages.withColumn("updated_at", F.lit(None).cast("timestamp")).unionByName(firms).unionByName(roles)


def sitemap_files(rows: DataFrame, per_file: int = SITEMAP_FILE) -> DataFrame:
    """The rows of a sitemap with `file`, a number from 0: files of about `per_file` rows, no URL left out."""
    files = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / per_file), F.lit(1)).alias("_files"))
    dealt = rows.crossJoin(F.broadcast(files))  # one row
    return dealt.withColumn("file", F.pmod(F.xxhash64("url"), F.col("_files")).cast("int")).drop("_files")


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def job_jsonld(jobs: DataFrame, companies: DataFrame, base: str) -> DataFrame:
    """(id, json): one schema.org JobPosting per job. Absent parts are left out, not null."""
    firm = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"), F.col("website").alias("_site"))
    remote = F.col("remote") == "REMOTE"
    kind = "@type"
    place = F.struct(
        F.lit("Place").alias(kind),
        F.struct(
            F.lit("PostalAddress").alias(kind),
            F.element_at(F.split("location", " · "), 1).alias("addressLocality"),
            F.lit("IN").alias("addressCountry"),
        ).alias("address"),
    )
    months = F.struct(
        F.lit("OccupationalExperienceRequirements").alias(kind), (F.col("experience_min") * 12).alias("monthsOfExperience")
    )
    pay = F.struct(
        F.lit("MonetaryAmount").alias(kind),
        F.col("currency"),
        F.struct(
            F.lit("QuantitativeValue").alias(kind),
            F.col("salary_min").alias("minValue"),
            F.col("salary_max").alias("maxValue"),
            F.lit("YEAR").alias("unitText"),
        ).alias("value"),
    )
    # The two forms of experienceRequirements differ in type, so each is rendered on its own.
    skilled = F.when(F.col("experience_min") > 0, months).alias("experienceRequirements")
    fresher = F.when(F.col("experience_min") == 0, "no requirements").alias("experienceRequirements")

    def document(experience: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit("https://schema.org").alias("@context"),
                F.lit("JobPosting").alias(kind),
                "title",
                "description",
                _iso(F.col("posted_at")).alias("datePosted"),
                _iso(expires_at(F.col("posted_at"))).alias("validThrough"),
                F.col("employment_type").alias("employmentType"),
                F.concat(F.lit(f"{base}/jobs/"), "slug").alias("url"),
                F.lit(False).alias("directApply"),
                F.struct(F.lit("Organization").alias(kind), F.col("_name").alias("name"), F.col("_site").alias("sameAs")).alias(
                    "hiringOrganization"
                ),
                F.when(remote, "TELECOMMUTE").alias("jobLocationType"),
                F.when(remote, F.struct(F.lit("Country").alias(kind), F.lit("India").alias("name"))).alias("applicantLocationRequirements"),
                F.when(~remote, place).alias("jobLocation"),
                experience,
                F.when(F.col("salary_disclosed") & F.col("currency").isNotNull(), pay).alias("baseSalary"),
            )
        )

    json = F.when(F.col("experience_min") == 0, document(fresher)).otherwise(document(skilled))
    # "<" must not close the script tag the document is put in.
    return jobs.join(firm, "company_id").select("id", F.replace(json, F.lit("<"), F.lit("\\u003c")).alias("json"))


# ------------------------------------------------------------------ CSV import

class ImportResult(NamedTuple):
    rows: DataFrame  # job rows, empty unless every record is valid
    errors: DataFrame  # row_number, errors


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """Records of one sheet: quoted multi-line fields, header lower-cased, blank rows dropped.

    `row_number` counts the header as row 1. A sheet is one file, which one task reads in order.
    """
    sheet = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    for name in sheet.columns:
        sheet = sheet.withColumnRenamed(name, name.strip("\ufeff \t").lower())
    cells = [F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in sheet.columns]
    filled = sheet.select(*cells).filter(F.concat(*sheet.columns) != "")
    return filled.withColumn("row_number", (F.monotonically_increasing_id() + 2).cast("int"))


def check_import(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Records joined to their company and validated: input columns, `errors`, `row_number`."""
    firms = companies.select(F.col("slug").alias("company_slug"), F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    joined = records.join(firms, "company_slug", "left")
    shaped = joined.withColumn("tags", F.replace(F.coalesce("tags", F.lit("")), F.lit(";"), F.lit(",")))
    for name in {"discipline", "level", "remote", "currency"} & set(records.columns):
        shaped = shaped.withColumn(name, F.upper(F.col(name)))
    checked = clean_job_input(shaped)
    unknown = F.when(F.col("company_id").isNull(), F.array(F.lit("company_slug: unknown")))
    return checked.withColumn("errors", F.coalesce(unknown, job_errors(checked)))


def import_jobs(records: DataFrame, companies: DataFrame) -> ImportResult:
    """All or nothing: one bad record leaves `rows` empty.

    The rejected count is joined back as a condition, so nothing is collected.
    """
    checked = check_import(records, companies)
    errors = checked.filter(F.size("errors") > 0).select("row_number", "errors")
    rejected = errors.agg(F.count(F.lit(1)).alias("_bad")).filter("_bad = 0").select(F.lit(0).alias("_k"))
    paid = F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull()
    suffix = F.substring(F.sha1(F.concat_ws("|", "company_id", "title", F.col("row_number").cast("string"))), 1, 6)
    rows = (
        checked.filter(F.size("errors") == 0)
        .withColumn("_k", F.lit(0))
        .join(F.broadcast(rejected), "_k", "left_semi")
        .select(
            "row_number", "company_id", "title", "description", "discipline", "level", "tags", "location", "remote", "remote_region",
            F.when(paid, F.col("salary_min")).alias("salary_min"),
            F.when(paid, F.col("salary_max")).alias("salary_max"),
            F.when(paid, F.col("currency")).alias("currency"),
            paid.alias("salary_disclosed"),
            "experience_min",
            F.when(F.col("experience_min").isNotNull(), F.col("experience_max")).alias("experience_max"),
            "apply_url", "featured",
            F.concat_ws("-", slugify(F.concat_ws(" ", "title", "company_name")), suffix).alias("slug"),
            search_text(F.col("title"), F.col("company_name"), F.col("location"), F.col("remote_region"), F.col("tags")).alias("search_text"),
        )
    )
    return ImportResult(rows, errors)


# ------------------------------------------------------------------ stored resumes

RESUME_TYPES = {
    "experience": "array<struct<role:string,company:string,location:string,start:string,`end`:string,current:boolean,bullets:array<string>>>",
    "projects": "array<struct<name:string,link:string,bullets:array<string>>>",
    "education": "array<struct<degree:string,institution:string,location:string,start:string,`end`:string,detail:string>>",
    "certifications": "array<struct<name:string,issuer:string,year:string>>",
}
# Longest text of each field, most entries of each section.
_LIMITS = {
    "experience": (15, {"role": 100, "company": 100, "location": 60, "start": 24, "end": 24}),
    "projects": (10, {"name": 100, "link": 300}),
    "education": (8, {"degree": 100, "institution": 120, "location": 60, "start": 24, "end": 24, "detail": 120}),
    "certifications": (12, {"name": 120, "issuer": 100, "year": 24}),
}
MAX_BULLETS, MAX_BULLET = 12, 400
MAX_HEADLINE, MAX_SUMMARY = 120, 1500


def _section_fits(name: str) -> Column:
    entries, fields = _LIMITS[name]

    def entry_fits(e: Column) -> Column:
        fits = F.lit(True)
        for field, longest in fields.items():
            fits = fits & (F.length(F.trim(F.coalesce(e[field], F.lit("")))) <= longest)
        if "bullets" in RESUME_TYPES[name]:
            bullets = F.coalesce(e["bullets"], F.array().cast("array<string>"))
            fits = fits & (F.size(bullets) <= MAX_BULLETS)
            fits = fits & F.forall(bullets, lambda b: F.length(F.trim(F.coalesce(b, F.lit("")))) <= MAX_BULLET)
        return fits

    return (F.size(name) <= entries) & F.forall(name, entry_fits)


def _clean_entries(name: str) -> Column:
    fields = _LIMITS[name][1]

    def entry(e: Column) -> Column:
        parts = [F.trim(F.coalesce(e[f], F.lit(""))).alias(f) for f in fields]
        if name == "experience":
            parts.append(F.coalesce(e["current"], F.lit(False)).alias("current"))
        if "bullets" in RESUME_TYPES[name]:
            bullets = F.coalesce(e["bullets"], F.array().cast("array<string>"))
            parts.append(F.filter(F.transform(bullets, lambda b: F.trim(F.coalesce(b, F.lit("")))), lambda b: b != "").alias("bullets"))
        return F.struct(*parts)

    return F.transform(name, entry)


def read_resumes(stored: DataFrame) -> DataFrame:
    """user_id, headline, summary, skills and the JSON sections as typed arrays.

    A document that does not hold to the limits comes back empty, whole.
    """
    parsed = stored.select(
        "user_id",
        F.trim(F.coalesce("headline", F.lit(""))).alias("headline"),
        F.trim(F.coalesce("summary", F.lit(""))).alias("summary"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        *[F.coalesce(F.from_json(name, kind), F.array().cast(kind)).alias(name) for name, kind in RESUME_TYPES.items()],
    )
    fits = (F.length("headline") <= MAX_HEADLINE) & (F.length("summary") <= MAX_SUMMARY)
    for name in RESUME_TYPES:
        fits = fits & F.coalesce(_section_fits(name), F.lit(False))
    skills = distinct_ignoring_case(F.transform("skills", lambda s: F.substring(F.trim(s), 1, 40)))
    judged = parsed.withColumn("_ok", fits)
    return judged.select(
        "user_id",
        F.when(F.col("_ok"), F.col("headline")).otherwise("").alias("headline"),
        F.when(F.col("_ok"), F.col("summary")).otherwise("").alias("summary"),
        F.when(F.col("_ok"), skills).otherwise(F.array().cast("array<string>")).alias("skills"),
        *[F.when(F.col("_ok"), _clean_entries(n)).otherwise(F.array().cast(k)).alias(n) for n, k in RESUME_TYPES.items()],
    )


MAX_RESUME_BYTES = 4 * 1024 * 1024


def safe_filename(name: Column) -> Column:
    """No path, no control characters or quotes, at most 100 characters, always `.pdf`."""
    base = F.regexp_replace(F.regexp_extract(name, r"[^\\/]*$", 0), r'[\x00-\x1f\x7f"\\]', "")
    stem = F.regexp_replace(F.trim(F.regexp_replace(base, r"\s+", " ")), r"(?i)\.pdf$", "")
    stem = F.trim(F.substring(stem, 1, 100))
    return F.concat(F.when(stem == "", "resume").otherwise(stem), F.lit(".pdf"))


def audit_files(files: DataFrame) -> DataFrame:
    """path, filename and why a file would be refused (null: it would not). Needs path, length, content."""
    reason = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("length") > MAX_RESUME_BYTES, "too_large")
        .when(F.substring("content", 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "not_a_pdf")
    )
    return files.select("path", safe_filename(F.col("path")).alias("filename"), reason.alias("reason"))


def read_resume_files(spark: SparkSession, path: str) -> DataFrame:
    return audit_files(spark.read.format("binaryFile").load(path))
