"""Integrity rules and input validation as violation tables and error arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.enums import (
    CURRENCY_ORDER,
    DISCIPLINE_ORDER,
    EDUCATION,
    EMPLOYMENT_TYPE,
    INDUSTRY,
    LEVEL_ORDER,
    REMOTE,
    SOURCE,
    STAGE,
)
from rolecall.functions.salary import parse_inr_amount

# Table -> rule name -> what must hold. A rule that is null passes, as a
# stored CHECK does, so a rule that must not be null says so itself.
CHECKS: dict[str, dict[str, str]] = {
    "job": {
        "salary_band": "(salary_min IS NULL AND salary_max IS NULL AND currency IS NULL AND salary_disclosed = false) OR "
        "(salary_min > 0 AND salary_max >= salary_min AND currency IS NOT NULL AND salary_disclosed = true)",
        "experience": "(experience_min IS NULL AND experience_max IS NULL) OR (experience_min IS NOT NULL AND "
        "experience_min BETWEEN 0 AND 40 AND (experience_max IS NULL OR experience_max BETWEEN experience_min AND 40))",
    },
    "candidate_profile": {
        "resume": "(resume_key IS NULL AND resume_filename IS NULL AND resume_size IS NULL AND resume_type IS NULL) OR "
        "(resume_key IS NOT NULL AND resume_filename IS NOT NULL AND resume_size > 0 AND resume_size <= 4194304 AND resume_type IS NOT NULL)",
        "years": "years_experience IS NULL OR (years_experience >= 0 AND years_experience <= 60)",
        "current_salary": "current_salary IS NULL OR (current_salary >= 1000 AND current_salary <= 200000000)",
        "expected_salary": "expected_salary IS NULL OR (expected_salary >= 1000 AND expected_salary <= 200000000)",
        "notice_period": "notice_period IS NULL OR (notice_period >= 0 AND notice_period <= 180)",
        "skills": "size(skills) <= 40",
    },
}


def check_constraints(df: DataFrame, table: str, key: str, rules: dict[str, str] | None = None) -> DataFrame:
    """(table, key, rule) of every broken rule, in one pass."""
    broken = [
        F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name)) for name, rule in (rules or CHECKS[table]).items()
    ]
    return df.select(
        F.lit(table).alias("table"), F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*broken))).alias("rule")
    )


def check_unique(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Keys held by more than one row. Rows with a null in the key are not compared."""
    full = df.dropna(subset=keys)
    repeated = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return repeated.select(F.lit(table).alias("table"), F.concat_ws("/", *keys).alias("key"), F.lit("unique " + ",".join(keys)).alias("rule"))


def check_reference(df: DataFrame, table: str, key: list[str], column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference names no parent row."""
    known = parent.select(F.col(parent_key).alias(column))
    orphans = df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
    return orphans.select(F.lit(table).alias("table"), F.concat_ws("/", *key).alias("key"), F.lit(f"reference {column}").alias("rule"))


# ------------------------------------------------------------------ form and sheet input

def _blank_to_null(column: Column) -> Column:
    text = F.trim(column.cast("string"))
    return F.when(text != "", text)


def _input(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


_NUMBERS = ["salary_min", "salary_max", "experience_min", "experience_max"]
_BAD_NUMBER = -(2**31)


def _whole_number(text: Column) -> Column:
    """The number a field holds; an out-of-range mark when it holds something else."""
    value = text.try_cast("double")
    whole = value.cast("long")
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(F.coalesce(F.when(value == whole, whole), F.lit(_BAD_NUMBER)))


def clean_job_input(df: DataFrame) -> DataFrame:
    """Text fields trimmed, numbers read, tags split, defaults applied. Other columns pass through."""
    tags = F.filter(F.transform(F.split(F.coalesce(_input(df, "tags"), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    cleaned = {
        "title": F.trim(_input(df, "title")),
        "description": F.trim(_input(df, "description")),
        "location": F.trim(_input(df, "location")),
        "remote_region": _blank_to_null(_input(df, "remote_region")),
        "employment_type": F.coalesce(_blank_to_null(_input(df, "employment_type")), F.lit("FULL_TIME")),
        "currency": F.coalesce(_blank_to_null(_input(df, "currency")), F.lit("INR")),
        "featured": F.coalesce(_input(df, "featured").cast("string").isin("on", "true"), F.lit(False)),
        "raw_tags": F.coalesce(_input(df, "tags"), F.lit("")),
        "tags": F.array_distinct(tags),
        **{n: _whole_number(_blank_to_null(_input(df, n))) for n in _NUMBERS},
    }
    kept = [c for c in df.columns if c not in cleaned]
    return df.select(*kept, *[c.alias(n) for n, c in cleaned.items()])


def _error(condition: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(True)), F.lit(message))


def _length(name: str, low: int, high: int) -> list[Column]:
    n = F.length(F.coalesce(F.col(name), F.lit("")))
    return [_error(n < low, f"{name}: too short"), _error(n > high, f"{name}: too long")]


def _one_of(name: str, domain: list[str]) -> Column:
    return _error(~F.col(name).isin(domain), f"{name}: invalid")


def _in_range(name: str, low: int, high: int) -> Column:
    return F.when(F.col(name).isNotNull() & ~F.col(name).between(low, high), F.lit(f"{name}: out of range"))


def _is_url(column: Column) -> Column:
    return column.rlike(r"(?i)^https?://[^\s/?#]+[^\s]*$") & (F.length(column) <= 2000)


def job_errors(df: DataFrame, recruiter: bool = False) -> Column:
    """Errors of cleaned job input. A recruiter's listing must publish its band."""
    lo, hi, first, last = (F.col(n) for n in _NUMBERS)
    errors = [
        *_length("title", 3, 120),
        *_length("description", 20, 20_000),
        _one_of("discipline", DISCIPLINE_ORDER),
        _one_of("level", LEVEL_ORDER),
        _one_of("employment_type", EMPLOYMENT_TYPE),
        _one_of("remote", REMOTE),
        _one_of("currency", CURRENCY_ORDER),
        _error(F.length("raw_tags") > 300, "tags: too long"),
        *_length("location", 2, 80),
        F.when(F.length("remote_region") > 40, F.lit("remote_region: too long")),
        _in_range("salary_min", 1, 200_000_000),
        _in_range("salary_max", 1, 200_000_000),
        _in_range("experience_min", 0, 40),
        _in_range("experience_max", 0, 40),
        _error(~_is_url(F.col("apply_url")), "apply_url: invalid"),
        F.when(lo.isNull() != hi.isNull(), F.lit("salary_max: give both ends or neither")),
        F.when(hi < lo, F.lit("salary_max: below the minimum")),
        F.when(first.isNull() & last.isNotNull(), F.lit("experience_min: give a minimum too")),
        F.when(last < first, F.lit("experience_max: below the minimum")),
    ]
    if recruiter:
        errors.append(F.when(lo.isNull() | hi.isNull(), F.lit("salary_min: publish the band")))
    return F.array_compact(F.array(*errors))


def profile_errors(df: DataFrame, year: int) -> Column:
    """Errors of a candidate profile as typed; pay is text like "18 LPA"."""
    phone = F.regexp_replace(F.coalesce(_input(df, "phone"), F.lit("")), r"[\s\-()]", "")

    def number(name: str, low: int, high: int) -> Column:
        value = _whole_number(_blank_to_null(_input(df, name)))
        return F.when(value.isNotNull() & ~value.between(low, high), F.lit(f"{name}: out of range"))

    def longest(name: str, limit: int) -> Column:
        return F.when(F.length(F.trim(_input(df, name))) > limit, F.lit(f"{name}: too long"))

    def pay(name: str) -> Column:
        typed = _blank_to_null(_input(df, name))
        return F.when(typed.isNotNull() & parse_inr_amount(typed).isNull(), F.lit(f"{name}: not an amount"))

    def site(name: str, host: str) -> Column:
        url = _blank_to_null(_input(df, name))
        at = F.regexp_extract(url, r"(?i)^https?://([^\s/?#:]+)", 1)
        return F.when(url.isNotNull() & ~(_is_url(url) & at.rlike(host)), F.lit(f"{name}: wrong address"))

    name = F.length(F.trim(F.coalesce(_input(df, "full_name"), F.lit(""))))
    level = _blank_to_null(_input(df, "education_level"))
    errors = [
        F.when(~name.between(1, 80), F.lit("full_name: required")),
        F.when((phone != "") & ~phone.rlike(r"^\+?[0-9]{7,15}$"), F.lit("phone: invalid")),
        longest("city", 60),
        number("years_experience", 0, 60),
        longest("current_title", 80),
        F.when(level.isNotNull() & ~level.isin(EDUCATION), F.lit("education_level: invalid")),
        longest("degree", 80),
        longest("institution", 120),
        number("graduation_year", 1950, year + 8),
        site("linkedin_url", r"(?i)(^|\.)linkedin\.com$"),
        site("github_url", r"(?i)(^|\.)github\.com$"),
        site("portfolio_url", r"."),
        pay("current_salary"),
        pay("expected_salary"),
        number("notice_period", 0, 180),
        longest("skills", 1200),
    ]
    return F.array_compact(F.array(*errors))


def review_errors(df: DataFrame) -> Column:
    rating = _whole_number(_blank_to_null(_input(df, "rating")))
    errors = [
        _error(~rating.between(1, 5), "rating: give 1 to 5"),
        *_length("title", 6, 120),
        *_length("pros", 20, 2000),
        *_length("cons", 20, 2000),
        F.when(F.length(F.trim(_input(df, "role_title"))) > 80, F.lit("role_title: too long")),
    ]
    return F.array_compact(F.array(*errors))


def stage_errors(df: DataFrame) -> Column:
    errors = [
        _error(~F.col("job_id").rlike(r"(?i)^[a-z0-9]{10,40}$"), "job_id: invalid"),
        _one_of("stage", STAGE),
        F.when(F.length(F.trim(_input(df, "note"))) > 500, F.lit("note: too long")),
    ]
    return F.array_compact(F.array(*errors))


def company_errors(df: DataFrame) -> Column:
    from rolecall.sources.feeds import valid_tokens

    name = F.length(F.trim(F.coalesce(_input(df, "name"), F.lit(""))))
    industry, source = _blank_to_null(_input(df, "industry")), _blank_to_null(_input(df, "ats_source"))
    days = _whole_number(_blank_to_null(_input(df, "median_response_days")))
    synced = [s for s in SOURCE if s != "MANUAL"]
    logo = _blank_to_null(_input(df, "logo_url"))
    token = F.trim(F.regexp_replace(F.coalesce(_input(df, "ats_token"), F.lit("")), r"\s+", " "))
    limits = {"description": 2000, "hq": 80, "size": 40}
    errors = [
        F.when(~name.between(2, 80), F.lit("name: 2 to 80 characters")),
        _error(~_is_url(_input(df, "website")), "website: invalid"),
        F.when(logo.isNotNull() & ~_is_url(logo), F.lit("logo_url: invalid")),
        *[F.when(F.length(F.trim(_input(df, n))) > m, F.lit(f"{n}: too long")) for n, m in limits.items()],
        F.when(industry.isNotNull() & ~industry.isin(INDUSTRY), F.lit("industry: invalid")),
        F.when(source.isNotNull() & ~source.isin(synced), F.lit("ats_source: invalid")),
        F.when(F.length(token) > 600, F.lit("ats_token: too long")),
        F.when(source.isin(synced) & ~valid_tokens(source, token), F.lit("ats_token: wrong form")),
        F.when(days.isNotNull() & ~days.between(0, 120), F.lit("median_response_days: out of range")),
    ]
    return F.array_compact(F.array(*errors))
