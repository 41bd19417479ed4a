"""Strings the site shows: pay, ages, places, years, and text cut for cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall.functions.text import squeeze

LAKH = 100_000
CRORE = 10_000_000


def _one_decimal(value: Column) -> Column:
    """Rounded half up to a tenth, without a trailing `.0`."""
    tenths = F.floor(value * 10 + 0.5).cast("long")
    whole = F.floor(tenths / 10).cast("long").cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(F.concat_ws(".", whole, (tenths % 10).cast("string")))


def format_inr_short(amount: Column) -> Column:
    return F.when(amount >= CRORE, F.concat(_one_decimal(amount / CRORE), F.lit(" Cr"))).otherwise(
        F.concat(_one_decimal(amount / LAKH), F.lit(" L"))
    )


def format_money(amount: Column, currency: Column) -> Column:
    sign = F.when(currency == "EUR", "€").when(currency == "GBP", "£").otherwise("US$")
    return F.when(currency == "INR", F.concat(F.lit("₹"), format_inr_short(amount))).otherwise(
        F.concat(sign, F.format_number(amount.cast("double"), 0))
    )


def format_salary_band(low: Column, high: Column, currency: Column) -> Column:
    """Null when the employer published no band."""
    lo, hi = _one_decimal(low / LAKH), _one_decimal(high / LAKH)
    lpa = F.when(lo == hi, F.concat(F.lit("₹"), lo, F.lit(" LPA"))).otherwise(F.concat(F.lit("₹"), lo, F.lit("–"), hi, F.lit(" LPA")))
    first, last = format_money(low, currency), format_money(high, currency)
    spread = F.when(low == high, first).otherwise(F.concat(first, F.lit(" – "), last))
    stated = low.isNotNull() & high.isNotNull() & currency.isNotNull()
    return F.when(stated, F.when((currency == "INR") & (high < CRORE), lpa).otherwise(spread))


def _days(at: Column, as_of: Column) -> Column:
    seconds = as_of.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    return F.greatest(F.floor(seconds / 86_400), F.lit(0)).cast("long")


def format_posted_ago(at: Column, as_of: Column) -> Column:
    days = _days(at, as_of)
    weeks, months = F.floor(days / 7), F.floor(days / 30)
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days, F.lit(" days ago")))
        .when(weeks == 1, "1 week ago")
        .when(weeks < 5, F.concat(weeks, F.lit(" weeks ago")))
        .when(months <= 1, "1 month ago")
        .otherwise(F.concat(months, F.lit(" months ago")))
    )


def format_age(at: Column, as_of: Column) -> Column:
    days = _days(at, as_of)
    return (
        F.when(days == 0, "Today").when(days < 7, F.concat(days, F.lit("d"))).otherwise(F.concat(F.floor(days / 7), F.lit("w")))
    )


def format_location(location: Column, remote: Column, region: Column) -> Column:
    where = F.when(region.isNotNull(), F.concat(F.lit("Remote ("), region, F.lit(")"))).otherwise("Remote")
    has_cities = (F.length(location) > 0) & (location != "India") & ~location.eqNullSafe(region)
    return (
        F.when(remote == "REMOTE", F.when(has_cities, F.concat(where, F.lit(" · "), location)).otherwise(where))
        .when(remote == "HYBRID", F.concat(F.lit("Hybrid · "), location))
        .otherwise(location)
    )


def format_experience(low: Column, high: Column) -> Column:
    def unit(n: Column) -> Column:
        return F.when(n == 1, " yr").otherwise(" yrs")

    return (
        F.when(low.isNull(), F.lit(None).cast("string"))
        .when(high.isNull(), F.concat(low, F.lit("+ yrs")))
        .when(low == high, F.concat(low, unit(low)))
        .otherwise(F.concat(low, F.lit("–"), high, unit(high)))
    )


def truncate_words(text: Column, limit: int) -> Column:
    """One line of at most `limit` characters: cut at a word when one ends past 60% of it,
    trailing punctuation off, `…` on."""
    clean = F.trim(squeeze(text))
    cut = F.substring(clean, 1, limit - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    near = F.contains(cut, F.lit(" ")) & (space > limit * 0.6)
    whole = F.when(near, F.substring(cut, F.lit(1), space)).otherwise(cut)
    short = F.concat(F.regexp_replace(whole, r"[\s,.;:·(–—-]+$", ""), F.lit("…"))
    return F.when(F.length(clean) <= limit, clean).otherwise(short)


def job_summary(title: Column, company: Column, place: Column, pay: Column, status: Column, site: str) -> Column:
    """What a job's preview card says: title, company and place cut to fit, pay, open, and the sentence read out for it."""
    place, is_open = truncate_words(place, 44), status == "ACTIVE"
    details = F.concat_ws(", ", pay, F.when(place != "", place))
    sentence = F.concat(title, F.lit(" at "), company, F.when(details != "", F.concat(F.lit(": "), details)).otherwise(""))
    alt = F.concat(sentence, F.when(is_open, "").otherwise(" (no longer open)"), F.lit(f". On {site}."))
    return F.struct(truncate_words(title, 90).alias("title"), truncate_words(company, 40).alias("company"), place.alias("place"), pay.alias("pay"), is_open.alias("open"), alt.alias("alt"))


def company_summary(name: Column, open_roles: Column, site: str) -> Column:
    """What a company's preview card says: its name cut to fit, its initial and its open roles."""
    counted = F.concat(F.format_number(open_roles, 0), F.when(open_roles == 1, " open role").otherwise(" open roles"))
    roles = F.when(open_roles == 0, "No open roles right now").otherwise(counted)
    first = F.upper(F.substring(F.trim(name), 1, 1))
    alt = F.concat(name, F.lit(f" on {site}. "), roles, F.lit("."))
    return F.struct(truncate_words(name, 48).alias("name"), F.when(first != "", first).otherwise("?").alias("initial"), roles.alias("roles"), alt.alias("alt"))


def safe_referrer(url: Column) -> Column:
    """Host and path only, at most 200 characters; null when it is no URL."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    path = F.regexp_extract(url, parts, 2)
    shown = F.concat(host, F.when(path == "", "/").otherwise(path))
    return F.when(host != "", F.substring(shown, 1, 200))


def country_code(code: Column) -> Column:
    return F.when(code.rlike(r"^[A-Z]{2}$"), code)


def heading_text(line: Column) -> Column:
    """The heading a description line stands for: `## ` lines, and short labels ending in a colon."""
    marked = F.trim(F.substring(line, F.lit(4), F.length(line)))
    label = F.trim(F.regexp_replace(line, ":$", ""))
    short = ~line.startswith("- ") & (F.length(line) <= 60) & line.endswith(":")
    plain = (label != "") & (F.size(F.split(label, r"\s+")) <= 8) & ~label.rlike(r"[.!?]")
    return F.when(line.startswith("## "), F.when(marked != "", marked)).when(short & plain, label)
