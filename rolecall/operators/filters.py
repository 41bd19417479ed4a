"""Facet predicates of the job search. Each takes and returns a DataFrame or a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.enums import CURRENCY_ORDER, DISCIPLINE_ORDER, EMPLOYMENT_TYPE, INDUSTRY, LEVEL_ORDER, REMOTE
from rolecall.functions.vocabulary import CITY_NAMES

LISTING_DAYS = 30

# Years-of-experience buckets [lo, hi), and the years a level stands for
# when a posting names none. An open ask ("3+") covers OPEN_SPAN years.
BUCKETS: dict[str, tuple[int, int | None]] = {
    "0-1": (0, 1),
    "1-3": (1, 3),
    "3-5": (3, 5),
    "5-8": (5, 8),
    "8-plus": (8, None),
}
OPEN_SPAN = 2
LEVEL_YEARS: dict[str, tuple[int, int | None]] = {
    "INTERN": (0, 1),
    "JUNIOR": (0, 2),
    "MID": (2, 5),
    "SENIOR": (5, None),
    "STAFF": (8, None),
    "PRINCIPAL": (10, None),
    "MANAGER": (8, None),
    "DIRECTOR": (10, None),
}


def is_active() -> Column:
    return F.col("status") == "ACTIVE"


def filter_active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_active())


def has_words(q: str) -> Column:
    """Every word occurs in search_text, as plain text."""
    condition = F.lit(True)
    for word in q.lower().split():
        condition = condition & F.col("search_text").contains(word)
    return condition


def in_location(location: str) -> Column:
    wanted = location.lower()
    if wanted == "remote":
        return F.col("remote") == "REMOTE"
    region = F.coalesce(F.lower("remote_region"), F.lit(""))
    return F.lower("location").contains(wanted) | region.contains(wanted)


def asks_between(lo: Column, hi: Column) -> Column:
    """The years a job asks for overlap [lo, hi); `hi` null means no upper end."""
    first = F.col("experience_min")
    end = F.when(F.col("experience_max").isNull(), first + OPEN_SPAN).otherwise(
        F.greatest("experience_max", first + 1)
    )
    return F.coalesce(first < hi, F.lit(True)) & (end > lo)


def levels_in(bucket: str) -> list[str]:
    lo, hi = BUCKETS[bucket]
    matching = []
    for level, (first, last) in LEVEL_YEARS.items():
        end = first + OPEN_SPAN if last is None else max(last, first + 1)
        if end > lo and (hi is None or first < hi):
            matching.append(level)
    return matching


def in_experience(bucket: str) -> Column:
    lo, hi = BUCKETS[bucket]
    stated = F.col("experience_min").isNotNull()
    by_years = stated & asks_between(F.lit(lo), F.lit(hi).cast("int"))
    return by_years | (~stated & F.col("level").isin(levels_in(bucket)))


def pays_at_least(rupees: int) -> Column:
    if not rupees:
        return F.lit(True)
    return (F.col("currency") == "INR") & (F.col("salary_max") >= rupees)


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def filter_industry(jobs: DataFrame, companies: DataFrame, industry: str) -> DataFrame:
    chosen = companies.filter(F.col("industry") == industry).select(F.col("id").alias("company_id"))
    return jobs.join(chosen, "company_id", "left_semi")


def name_contains(text: str) -> Column:
    """Company directory box: case-insensitive substring of the name."""
    return F.lower("name").contains(text.strip().lower())


@dataclass(frozen=True)
class SearchParams:
    q: str | None = None
    location: str | None = None
    remote: str | None = None
    discipline: str | None = None
    level: str | None = None
    exp: str | None = None
    employment_type: str | None = None
    industry: str | None = None
    currency: str | None = None
    min_salary: int | None = None
    tag: str | None = None
    city: str | None = None
    salary: bool | None = None

    def predicate(self) -> Column:
        """Everything but `industry`, which lives on the company."""
        parts = [is_active()]
        if self.q:
            parts.append(has_words(self.q))
        if self.location:
            parts.append(in_location(self.location))
        for name in ("remote", "discipline", "level", "employment_type", "currency"):
            value = getattr(self, name)
            if value:
                parts.append(F.col(name) == value)
        if self.exp:
            parts.append(in_experience(self.exp))
        if self.city:
            parts.append(F.col("location").contains(self.city))
        if self.salary:
            parts.append(F.col("salary_disclosed"))
        if self.min_salary:
            parts.append(pays_at_least(self.min_salary))
        if self.tag:
            parts.append(has_tag(self.tag))
        condition = parts[0]
        for part in parts[1:]:
            condition = condition & part
        return condition

    def active(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name)]


def apply_search(jobs: DataFrame, companies: DataFrame | None, params: SearchParams) -> DataFrame:
    matched = jobs.filter(params.predicate())
    if params.industry:
        matched = filter_industry(matched, companies, params.industry)
    return matched


# ------------------------------------------------------------------ parameter rows

_TEXTS = ["q", "location", "tag"]
_DOMAINS = {
    "remote": REMOTE,
    "discipline": DISCIPLINE_ORDER,
    "level": LEVEL_ORDER,
    "exp": list(BUCKETS),
    "employment_type": EMPLOYMENT_TYPE,
    "industry": INDUSTRY,
    "currency": CURRENCY_ORDER,
    "city": CITY_NAMES,
    "salary": ["1"],
    "sort": ["recommended", "newest", "salary"],
}
MAX_SALARY_FILTER = 200_000_000
CURSOR_PATTERN = r"^[A-Za-z0-9]{10,40}$"


def parse_search_params(raw: DataFrame) -> DataFrame:
    """Raw query-string columns (each `array<string>`, first value wins) to clean values.

    A value that does not validate becomes null instead of failing the search.
    """
    columns = []
    for name in raw.columns:
        value = F.try_element_at(F.col(name), F.lit(1)) if raw.schema[name].dataType.typeName() == "array" else F.col(name)
        if name in _TEXTS:
            text = F.trim(value)
            value = F.when(F.length(text) > 0, text)
        elif name == "min_salary":
            number = value.try_cast("double")
            whole = number.cast("long")
            value = F.when((number == whole) & whole.between(0, MAX_SALARY_FILTER), whole)
        elif name == "cursor":
            value = F.when(value.rlike(CURSOR_PATTERN), value)
        elif name in _DOMAINS:
            value = F.when(value.isin(_DOMAINS[name]), value)
        if name == "sort":
            value = F.when(value != "recommended", value)
        columns.append(value.alias(name))
    return raw.select(*columns)


def active_filters(params: DataFrame, names: list[str]) -> Column:
    """Names of the facets a parameter row sets, in the given order."""
    marks = [F.when(F.col(n).isNotNull() & (F.col(n).cast("string") != "0"), F.lit(n)) for n in names]
    return F.array_compact(F.array(*marks))


# ------------------------------------------------------------------ age and status

def listing_cutoff(as_of: Column) -> Column:
    return as_of - F.expr(f"INTERVAL '{LISTING_DAYS}' DAY")


def expires_at(posted_at: Column) -> Column:
    return posted_at + F.expr(f"INTERVAL '{LISTING_DAYS}' DAY")


def is_public() -> Column:
    return F.col("status").isin("ACTIVE", "CLOSED", "EXPIRED")


ID_PATTERN = re.compile(r"^[a-z0-9]{10,40}$", re.I)


def jobs_by_ids(jobs: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Any status; malformed ids are ignored. `ids`: a table with a column id, or a request's list."""
    if isinstance(ids, list):
        ids = jobs.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return jobs.join(ids.filter(F.col("id").rlike(f"(?i){ID_PATTERN.pattern}")).select("id").distinct(), "id", "left_semi")
