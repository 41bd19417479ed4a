"""Changes people make: moderation, recruiter and operator actions, claims, application stages.

Each takes the stored table and a batch of requests and returns the next
version of the table; requests that are not allowed come back on their own.
Requests hold at most one row per target key (see `latest` for reducing them).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.text import search_text, slugify
from rolecall.operators.windows import number_rows
from rolecall.sources.tables import upsert

# Personal mail providers, which prove nothing about an employer.
FREE_EMAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.in", "yahoo.co.in", "outlook.com", "hotmail.com", "live.com",
    "icloud.com", "me.com", "proton.me", "protonmail.com", "rediffmail.com", "zoho.com", "aol.com", "mail.com", "yandex.com",
]


class Change(NamedTuple):
    table: DataFrame
    refused: DataFrame


def _replace(df: DataFrame, changes: dict[str, Column], stored: list[str]) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in stored])


def apply_moderation(target: DataFrame, decisions: DataFrame, as_of: Column, key: str = "id", job: bool = False) -> Change:
    """Approve or turn down queued rows. `decisions`: key, decision, review_note.

    A refusal needs a reason. Approving a job publishes it now: it becomes ACTIVE
    and its clocks start again.
    """
    note = F.trim(F.coalesce("review_note", F.lit("")))
    valid = F.col("decision").isin("APPROVED", "REJECTED") & ((F.col("decision") == "APPROVED") | (note != ""))
    known = decisions.join(target.select(key), key, "left_semi")
    sound = known.filter(valid).select(key, F.col("decision").alias("_decision"), note.alias("_note"))
    refused = decisions.filter(~valid).select(key, F.lit("no reason given").alias("why")).unionByName(
        decisions.filter(valid).join(target.select(key), key, "left_anti").select(key, F.lit("unknown").alias("why"))
    )
    joined = target.join(sound, key, "left")
    decided, approved = F.col("_decision").isNotNull(), F.col("_decision") == "APPROVED"
    note_column = "moderation_note" if job else "review_note"
    changes = {
        "status": F.when(approved, "ACTIVE" if job else "APPROVED").when(decided, "REJECTED").otherwise(F.col("status")),
        note_column: F.when(approved, F.lit(None)).when(decided, F.col("_note")).otherwise(F.col(note_column)),
        "reviewed_at": F.when(decided, as_of).otherwise(F.col("reviewed_at")),
    }
    if job:
        for clock in ("last_verified_at", "posted_at"):
            changes[clock] = F.when(approved, as_of).otherwise(F.col(clock))
    return Change(_replace(joined, changes, target.columns), refused)


def approved_company(members: DataFrame) -> DataFrame:
    """(user_id, company_id): the one company a recruiter may post for, the first approved."""
    approved = members.filter(F.col("status") == "APPROVED")
    return approved.groupBy("user_id").agg(F.min_by("company_id", F.struct("created_at", "company_id")).alias("company_id"))


def recruiter_intents(jobs: DataFrame, intents: DataFrame, members: DataFrame, recruiters: DataFrame, as_of: Column) -> Change:
    """Close, renew, re-open or edit own listings. `intents`: user_id, job_id, intent.

    Only the poster may act, within the company they are approved for. Renewing
    needs a live listing and re-opening a closed one; an edit of anything but a
    closed listing, like a re-opened one, goes back to review.
    """
    allowed = approved_company(members).join(recruiters.select("user_id"), "user_id", "left_semi")
    own = jobs.select(
        F.col("id").alias("job_id"), F.col("company_id"), F.col("posted_by_id").alias("user_id"), F.col("status").alias("_status")
    )
    mine = own.join(allowed, ["user_id", "company_id"], "left_semi")
    judged = intents.join(mine.select("job_id", "user_id", "_status"), ["job_id", "user_id"], "left")
    why = (
        F.when(F.col("_status").isNull(), "not your listing")
        .when(~F.col("intent").isin("CLOSE", "RENEW", "REOPEN", "EDIT"), "unknown intent")
        .when((F.col("intent") == "RENEW") & (F.col("_status") != "ACTIVE"), "only a live listing can be renewed")
        .when((F.col("intent") == "REOPEN") & (F.col("_status") != "CLOSED"), "not closed")
    )
    judged = judged.withColumn("why", why)
    sound = judged.filter(F.col("why").isNull()).select(F.col("job_id").alias("id"), F.col("intent").alias("_intent"))
    intent = F.coalesce("_intent", F.lit(""))
    to_review = (intent == "REOPEN") | ((intent == "EDIT") & (F.col("status") != "CLOSED"))
    changes = {
        "status": F.when(intent == "CLOSE", "CLOSED").when(to_review, "PENDING").otherwise(F.col("status")),
        "last_verified_at": F.when(intent.isin("RENEW", "REOPEN"), as_of).otherwise(F.col("last_verified_at")),
        "moderation_note": F.when(~to_review, F.col("moderation_note")),
        "reviewed_at": F.when(~to_review, F.col("reviewed_at")),
    }
    table = _replace(jobs.join(sound, "id", "left"), changes, jobs.columns)
    return Change(table, judged.filter(F.col("why").isNotNull()).select("user_id", "job_id", "intent", "why"))


def admin_job_actions(jobs: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """`actions`: id, action in ACTIVATE, EXPIRE, CONFIRM, EDIT, DELETE. Everything but
    EXPIRE and DELETE also confirms the listing."""
    joined = jobs.join(actions.select("id", F.col("action").alias("_action")), "id", "left")
    action = F.coalesce("_action", F.lit(""))
    changes = {
        "status": F.when(action.isin("ACTIVATE", "CONFIRM"), "ACTIVE").when(action == "EXPIRE", "EXPIRED").otherwise(F.col("status")),
        "last_verified_at": F.when(action.isin("ACTIVATE", "CONFIRM", "EDIT"), as_of).otherwise(F.col("last_verified_at")),
    }
    return _replace(joined.filter(action != "DELETE"), changes, jobs.columns)


def claim_companies(members: DataFrame, claims: DataFrame, companies: DataFrame) -> Change:
    """Recruiters asking for a company. `claims`: user_id, company_id, work_email, note, created_at.

    An approved or waiting claim stays as it is; a refused one goes back to the
    queue. Addresses at personal mail providers are refused.
    """
    domain = F.lower(F.element_at(F.split("work_email", "@"), -1))
    shaped = F.col("work_email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length("work_email") <= 160)
    why = F.when(~shaped, "not an email address").when(domain.isin(FREE_EMAIL_DOMAINS), "personal email address")
    judged = claims.withColumn("why", why)
    known = companies.select(F.col("id").alias("company_id"))
    unknown = judged.filter(F.col("why").isNull()).join(known, "company_id", "left_anti").withColumn("why", F.lit("unknown company"))
    sound = judged.filter(F.col("why").isNull()).drop("why").join(known, "company_id", "left_semi")
    again = F.col("t.status") == "REJECTED"
    table = upsert(
        members,
        sound,
        ["user_id", "company_id"],
        update={
            "work_email": F.when(again, F.col("s.work_email")).otherwise(F.col("t.work_email")),
            "note": F.when(again, F.col("s.note")).otherwise(F.col("t.note")),
            "status": F.when(again, "PENDING").otherwise(F.col("t.status")),
            "review_note": F.when(~again, F.col("t.review_note")),
            "reviewed_at": F.when(~again, F.col("t.reviewed_at")),
        },
        insert={"status": F.lit("PENDING")},
    )
    refused = judged.filter(F.col("why").isNotNull()).unionByName(unknown).select("user_id", "company_id", "why")
    return Change(table, refused)


def set_stages(applications: DataFrame, changes: DataFrame, as_of: Column) -> Change:
    """A candidate's own stage and note. `changes`: user_id, job_id, stage, note. Only existing
    applications change."""
    pair = ["user_id", "job_id"]
    sent = changes.select(*pair, F.col("stage").alias("_stage"), F.col("note").alias("_note"))
    changed = F.col("_stage").isNotNull()
    fields = {
        "stage": F.coalesce("_stage", "stage"),
        "note": F.when(changed, F.col("_note")).otherwise(F.col("note")),
        "stage_updated_at": F.when(changed, as_of).otherwise(F.col("stage_updated_at")),
    }
    table = _replace(applications.join(sent, pair, "left"), fields, applications.columns)
    return Change(table, changes.join(applications.select(*pair), pair, "left_anti").select(*pair))


def promote_recruiters(users: DataFrame, requests: DataFrame) -> DataFrame:
    """SEEKER becomes RECRUITER on request; no role is ever taken back."""
    asked = requests.select(F.col("user_id").alias("id"), F.lit(True).alias("_asked")).distinct()
    role = F.when(F.col("_asked") & (F.col("role") == "SEEKER"), "RECRUITER").otherwise(F.col("role"))
    return _replace(users.join(asked, "id", "left"), {"role": role}, users.columns)


def rename_companies(jobs: DataFrame, renamed: DataFrame) -> DataFrame:
    """Jobs of renamed companies (`id`, `name`) with their search text rebuilt; the rest untouched."""
    names = renamed.select(F.col("id").alias("company_id"), F.col("name").alias("_name"))
    text = search_text(F.col("title"), F.col("_name"), F.col("location"), F.col("remote_region"), F.col("tags"))
    fields = {"search_text": F.when(F.col("_name").isNotNull(), text).otherwise(F.col("search_text"))}
    return _replace(jobs.join(names, "company_id", "left"), fields, jobs.columns)


def _beginnings(text: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))


def company_slugs(companies: DataFrame, new: DataFrame) -> DataFrame:
    """Slugs for new companies (`name`, `created_at`): the name, then numbered by how many
    stored or earlier new slugs begin the same way.

    Slugs are counted under each of their beginnings that is a new name's base, so
    the prefix test is an equi-join. A new slug begins as its base does: the number
    behind it is not held against a base that ends in that number.
    """
    base = F.when(slugify(F.col("name")) != "", slugify(F.col("name"))).otherwise("company")
    wanted = new.withColumn("base", base)
    bases = wanted.select(F.col("base").alias("begins")).distinct()
    taken = (
        companies.filter(F.length("slug") > 0)
        .select(F.explode(_beginnings("slug")).alias("begins"))
        .join(bases, "begins", "left_semi")
        .groupBy("begins")
        .agg(F.count(F.lit(1)).alias("_taken"))
    )
    own = F.col("begins") == F.col("base")
    met = wanted.select("*", F.explode(_beginnings("base")).alias("begins")).join(bases, "begins", "left_semi")
    # A row counts under every beginning and keeps its columns under its own base.
    narrow = met.select("begins", "created_at", "name", F.when(own, F.struct(*new.columns)).alias("_row"))
    numbered = number_rows(narrow, ["begins"], ["created_at", "name"], "_earlier").filter("_row IS NOT NULL").join(taken, "begins", "left")
    count = F.coalesce("_taken", F.lit(0)) + F.col("_earlier")
    slug = F.when(count > 0, F.concat_ws("-", "begins", (count + 1).cast("string"))).otherwise(F.col("begins"))
    return numbered.select("_row.*", slug.alias("slug"))
