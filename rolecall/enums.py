"""Closed value domains and their sort order.

The lists are fixed values. Where a list is used for ordering it is in the
order the stored values sort, which for CURRENCY, LEVEL and STATUS is neither
alphabetical nor the order a form shows them in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCY_ORDER = ["EUR", "GBP", "USD", "INR"]
LEVEL_ORDER = ["JUNIOR", "MID", "SENIOR", "STAFF", "PRINCIPAL", "MANAGER", "DIRECTOR", "INTERN"]
STATUS_ORDER = ["ACTIVE", "EXPIRED", "PENDING", "REJECTED", "CLOSED"]
DISCIPLINE_ORDER = ["ENGINEERING", "DESIGN", "PRODUCT", "DATA", "SECURITY", "INFRASTRUCTURE"]

REMOTE = ["ONSITE", "HYBRID", "REMOTE"]
EMPLOYMENT_TYPE = ["FULL_TIME", "PART_TIME", "CONTRACT", "INTERNSHIP", "TEMPORARY"]
INDUSTRY = [
    "SAAS", "FINTECH", "ECOMMERCE", "HEALTHTECH", "EDTECH", "GAMING", "AI_ML", "SECURITY",
    "CONSUMER", "MOBILITY", "LOGISTICS", "MEDIA", "IT_SERVICES", "HARDWARE", "ENERGY", "OTHER",
]
SOURCE = [
    "MANUAL", "GREENHOUSE", "LEVER", "ASHBY", "WORKDAY", "SMARTRECRUITERS", "EIGHTFOLD", "ORACLE", "AMAZON",
]
STAGE = ["APPLIED", "INTERVIEWING", "OFFER", "REJECTED", "GHOSTED"]
EDUCATION = ["HIGH_SCHOOL", "DIPLOMA", "BACHELORS", "MASTERS", "DOCTORATE", "OTHER"]

# Search-style feeds that list roles without their text.
LIST_ONLY_SOURCES = ["WORKDAY", "SMARTRECRUITERS", "EIGHTFOLD", "ORACLE"]

# Display labels.
DISCIPLINE_LABEL = {
    "ENGINEERING": "Engineering", "DESIGN": "Design", "PRODUCT": "Product",
    "DATA": "Data", "SECURITY": "Security", "INFRASTRUCTURE": "Infrastructure",
}
LEVEL_LABEL = {
    "INTERN": "Intern", "JUNIOR": "Junior", "MID": "Mid-level", "SENIOR": "Senior",
    "STAFF": "Staff", "PRINCIPAL": "Principal", "MANAGER": "Manager", "DIRECTOR": "Director",
}
REMOTE_LABEL = {"ONSITE": "On-site", "HYBRID": "Hybrid", "REMOTE": "Remote"}
EMPLOYMENT_TYPE_LABEL = {
    "FULL_TIME": "Full-time", "PART_TIME": "Part-time", "CONTRACT": "Contract",
    "INTERNSHIP": "Internship", "TEMPORARY": "Temporary",
}


def ordinal(order: list[str], column: Column) -> Column:
    """1-based position of the value in its domain; null stays null."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), column)


def label(labels: dict[str, str], column: Column) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.element_at(F.create_map(*pairs), column)
