"""The three total orders of a job list and the keyset condition that pages them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rolecall.enums import CURRENCY_ORDER, ordinal

PAGE = 20
SORTS = ("recommended", "newest", "salary")
CURSOR_COLUMNS = ["id", "posted_at", "salary_disclosed", "currency", "salary_min", "salary_max"]

# Every key sorts descending with nulls last, so an order is just a list of columns.
_KEYS = {
    "recommended": ["salary_disclosed", "posted_at", "id"],
    "newest": ["posted_at", "id"],
    "salary": ["salary_disclosed", "currency", "salary_max", "salary_min", "posted_at", "id"],
    "home": ["salary_disclosed", "featured", "posted_at", "id"],
}


def _comparable(name: str) -> Column:
    return ordinal(CURRENCY_ORDER, F.col("currency")) if name == "currency" else F.col(name)


def _cursor_value(name: str, cursor: Row | dict[str, Any]) -> Any:
    value = cursor[name]
    if name == "currency" and value is not None:
        return CURRENCY_ORDER.index(value) + 1
    return value


def order_by(sort: str = "recommended") -> list[Column]:
    return [_comparable(name).desc_nulls_last() for name in _KEYS[sort]]


def sort_key(sort: Column) -> Column:
    """One value per row that descends in the order a column names; null is its end, as it is for structs."""
    disclosed, by_pay = sort.isin("recommended", "salary"), sort == "salary"
    pay = [F.when(by_pay, _comparable(name)).alias(f"_{name}") for name in ("currency", "salary_max", "salary_min")]
    return F.struct(F.when(disclosed, F.col("salary_disclosed")).alias("_disclosed"), *pay, "posted_at", "id")


def after_cursor(sort: str, cursor: Row | dict[str, Any]) -> Column:
    """Rows strictly after the cursor row, which need not be in the result any more.

    Built from the last key outwards: later on this key, or level on it and
    later on the rest. Null is the end of a key, so nothing is later than null.
    """
    condition = F.lit(False)
    for name in reversed(_KEYS[sort]):
        column, value = _comparable(name), _cursor_value(name, cursor)
        if value is None:
            condition = column.isNull() & condition
        else:
            later = column.isNull() | (column < F.lit(value))
            condition = later | ((column == F.lit(value)) & condition)
    return F.coalesce(condition, F.lit(False))


def page(jobs: DataFrame, sort: str = "recommended", cursor: Row | None = None, size: int = PAGE) -> DataFrame:
    """`size` rows and one more, which says whether another page follows."""
    rows = jobs if cursor is None else jobs.filter(after_cursor(sort, cursor))
    return rows.orderBy(*order_by(sort)).limit(size + 1)


def cursor_row(jobs: DataFrame, job_id: str) -> Row | None:
    """The one stored row a cursor names."""
    return jobs.filter(F.col("id") == job_id).select(*CURSOR_COLUMNS).first()
