"""Resumes in bulk: layout, review, hints, keyword gap against a job, and merging.

A resume row has headline, summary, skills and the section arrays (see
`read_resumes`); contact columns are full_name, email, phone, city and the links.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.classify import extract_tags
from rolecall.functions.resume_words import ACTION_VERBS, MONTHS, NUMBER, TITLE_FILLER, WEAK_OPENERS
from rolecall.functions.text import bind, constant, squeeze
from rolecall.operators.sets import distinct_ignoring_case, union_skills

LONG_BULLET, SHORT_BULLET = 220, 25
# Stands in for the printed page count, which needs font metrics: characters on a full page.
PAGE_CHARACTERS = 3000

_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def clean(text: Column) -> Column:
    return F.trim(squeeze(F.coalesce(text, F.lit(""))))


def _kept(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, _empty()), clean), lambda v: v != "")


def _parts(separator: str, *values: Column) -> Column:
    return F.array_join(F.filter(F.array(*values), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""), separator)


# ------------------------------------------------------------------ small formats

def _number(digits: Column) -> Column:
    """Matched digits as a number, null without a match; a failing `try_cast` would cost an exception a row."""
    return F.when(digits != "", digits).cast("int")


def format_resume_date(value: Column) -> Column:
    """`2021-03` as `Mar 2021`; anything else as written."""
    text = F.trim(F.coalesce(value, F.lit("")))
    month = _number(F.regexp_extract(text, r"^(\d{4})-(\d{1,2})$", 2))
    name = F.try_element_at(constant(MONTHS, _STRINGS), F.when(month.between(1, 12), month).otherwise(F.lit(13)))
    return F.coalesce(F.concat(name, F.lit(" "), F.substring(text, 1, 4)), text)


def format_date_range(start: Column, end: Column, current: Column) -> Column:
    last = F.when(current, F.lit("Present")).otherwise(format_resume_date(end))
    return _parts(" – ", format_resume_date(start), last)


def short_link(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean(url), r"(?i)^https?://", ""), r"(?i)^www\.", ""), "/$", "")


def format_phone(phone: Column) -> Column:
    """An Indian mobile as `+91 98765 43210`; other numbers as written."""
    text = clean(phone)
    local = F.regexp_extract(F.regexp_replace(text, r"\D", ""), r"^(?:0?91|0)?([6-9]\d{9})$", 1)
    return F.when(local != "", F.concat_ws(" ", F.lit("+91"), F.substring(local, 1, 5), F.substring(local, 6, 5))).otherwise(text)


def starts_with_verb(bullet: Column) -> Column:
    return F.array_contains(constant(ACTION_VERBS, _STRINGS), F.regexp_extract(F.lower(bullet), r"[a-z]+", 0))


def has_number(bullet: Column) -> Column:
    return bullet.rlike(NUMBER)


def _printable_set() -> str:
    """Characters outside ASCII that print, by themselves or folded to ASCII."""
    # Typography replaced by plain characters.
    folded = "–—−‘’‚“”„…•·→₹\u00a0\u2002\u2003\u2009\u202f"
    by_rule = [
        chr(code)
        for code in range(0x80, 0x10000)
        if not 0xD800 <= code <= 0xDFFF and any(0x20 < ord(c) < 0x7F for c in unicodedata.normalize("NFKD", chr(code)))
    ]
    return folded + "".join(by_rule)


_PRINTABLE = _printable_set()


def unrenderable(text: Column) -> Column:
    """Characters that would be lost in print, each once, in order."""
    left = F.translate(F.regexp_replace(text, r"[\x20-\x7E\s]+", ""), _PRINTABLE, "")
    return F.array_distinct(F.filter(F.split(left, ""), lambda c: c != ""))


# ------------------------------------------------------------------ layout

def _block(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), clean(text).alias("text"))


def _entry_blocks(entries: Column, title, meta) -> Column:
    """Title, meta line and bullets of each entry, one after the other."""

    def lines(e: Column) -> Column:
        head = F.array(_block("entryTitle", title(e)), _block("entryMeta", meta(e)))
        return F.concat(head, F.transform(F.coalesce(e["bullets"], _empty()), lambda b: _block("bullet", b)))

    return F.flatten(F.transform(entries, lines))


def _named(section: str, *fields: str) -> Column:
    """Entries of a section with any of the given fields filled."""

    def any_filled(e: Column) -> Column:
        condition = F.lit(False)
        for field in fields:
            condition = condition | (clean(e[field]) != "")
        return condition

    return F.filter(section, any_filled)


def layout_blocks() -> Column:
    """array<struct<kind, text>> of a resume in reading order; empty lines left out."""
    experience = _named("experience", "role", "company")
    projects = _named("projects", "name")
    education = _named("education", "degree", "institution")
    certifications = _named("certifications", "name")
    none = F.array().cast("array<struct<kind:string,text:string>>")

    def section(heading: str, blocks: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.array(_block("heading", F.lit(heading))), blocks)).otherwise(none)

    skills = F.array_join(_kept(F.col("skills")), ", ")
    header = F.array(
        _block("name", F.col("full_name")),
        _block("headline", F.col("headline")),
        _block("contact", _parts(" · ", F.col("city"), format_phone(F.col("phone")), F.col("email"))),
        _block("contact", _parts(" · ", short_link(F.col("linkedin_url")), short_link(F.col("github_url")), short_link(F.col("portfolio_url")))),
    )
    jobs = _entry_blocks(
        experience,
        lambda e: _parts(" · ", e["role"], e["company"]),
        lambda e: _parts(" · ", e["location"], format_date_range(e["start"], e["end"], e["current"])),
    )
    studies = F.flatten(
        F.transform(
            education,
            lambda e: F.array(
                _block("entryTitle", _parts(" · ", e["degree"], e["institution"])),
                _block("entryMeta", _parts(" · ", e["location"], format_date_range(e["start"], e["end"], F.lit(False)), e["detail"])),
            ),
        )
    )
    works = _entry_blocks(projects, lambda p: p["name"], lambda p: short_link(p["link"]))
    papers = F.transform(certifications, lambda c: _block("text", _parts(" · ", c["name"], c["issuer"], c["year"])))
    blocks = F.concat(
        header,
        section("Summary", F.array(_block("text", F.col("summary"))), clean(F.col("summary")) != ""),
        section("Skills", F.array(_block("text", skills)), skills != ""),
        section("Experience", jobs, F.size(experience) > 0),
        section("Projects", works, F.size(projects) > 0),
        section("Education", studies, F.size(education) > 0),
        section("Certifications", papers, F.size(certifications) > 0),
    )
    return F.filter(blocks, lambda b: b["text"] != "")


def layout_rows(resumes: DataFrame) -> DataFrame:
    """(user_id, pos, kind, text) of every block."""
    laid = resumes.select("user_id", F.posexplode(layout_blocks()).alias("pos", "b"))
    return laid.select("user_id", "pos", "b.kind", "b.text")


def plain_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")


def all_bullets() -> Column:
    both = F.concat(F.transform("experience", lambda e: e["bullets"]), F.transform("projects", lambda p: p["bullets"]))
    return _kept(F.flatten(F.transform(both, lambda b: F.coalesce(b, _empty()))))


# ------------------------------------------------------------------ review

def review_resumes(resumes: DataFrame) -> DataFrame:
    """Adds `checks` (id, status, weight), `score` 0–100, `verdict`, `recognised_skills`, `pages`."""
    facts = resumes.withColumn("_blocks", layout_blocks()).withColumn("_bullets", all_bullets())
    facts = facts.withColumn("_text", plain_text(F.col("_blocks"))).withColumn("_skills", _kept(F.col("skills")))
    started = _named("experience", "role", "company")
    dated = F.filter(
        started,
        lambda e: (clean(e["start"]) != "") & (F.coalesce(e["current"], F.lit(False)) | (clean(e["end"]) != "")),
    )
    thin = F.filter(started, lambda e: F.size(_kept(e["bullets"])) < 2)
    blank = [(clean(F.col(c)) == "").cast("int") for c in ("full_name", "phone", "city")]
    links = [(clean(F.col(c)) != "").cast("int") for c in ("linkedin_url", "github_url", "portfolio_url")]
    joined = F.array_join("_skills", ", ")
    facts = facts.select(
        "*",
        (blank[0] + blank[1] + blank[2]).alias("_missing"),
        (links[0] + links[1] + links[2]).alias("_links"),
        F.length(F.trim("headline")).alias("_headline"),
        F.length(F.trim("summary")).alias("_summary"),
        F.size(started).alias("_roles"),
        F.size(dated).alias("_dated"),
        F.size(thin).alias("_thin"),
        F.size("_bullets").alias("_n"),
        F.size(F.filter("_bullets", starts_with_verb)).alias("_verbs"),
        F.size(F.filter("_bullets", has_number)).alias("_numbers"),
        F.size(F.filter("_bullets", lambda b: F.length(b) > LONG_BULLET)).alias("_long"),
        F.size(_named("education", "degree", "institution")).alias("_studies"),
        F.size(unrenderable(F.col("_text"))).alias("_lost"),
        F.greatest(F.ceil(F.length("_text") / PAGE_CHARACTERS), F.lit(1)).cast("int").alias("pages"),
        extract_tags(F.trim("headline"), F.concat_ws("\n", joined, F.array_join("_bullets", " "))).alias("recognised_skills"),
        F.size(extract_tags(F.lit(""), joined)).alias("_known"),
    )
    c = F.col
    skills = F.size("_skills")

    def check(name: str, weight: int, good: Column, fair: Column) -> Column:
        status = F.when(good, "pass").when(fair, "warn").otherwise("fail")
        return F.struct(F.lit(name).alias("id"), status.alias("status"), F.lit(weight).alias("weight"))

    yes = F.lit(True)
    checks = [
        check("contact", 10, c("_missing") == 0, c("_missing") == 1),
        check("links", 5, c("_links") > 0, yes),
        check("headline", 8, c("_headline").between(3, 70), c("_headline") > 0),
        check("summary", 8, c("_summary").between(120, 700), c("_summary") > 0),
        check("experience", 14, (c("_roles") > 0) & (c("_dated") == c("_roles")), c("_roles") > 0),
        check("bullets", 12, (c("_roles") > 0) & (c("_thin") == 0), c("_roles") > 0),
        check("verbs", 8, (c("_n") > 0) & (c("_verbs") >= c("_n") * 0.7), (c("_n") > 0) & (c("_verbs") >= c("_n") * 0.4)),
        check("metrics", 10, (c("_n") > 0) & (c("_numbers") >= c("_n") * 0.4), c("_numbers") > 0),
        F.when(c("_long") > 0, check("bullet-length", 3, F.lit(False), yes)),
        check("skills", 12, (skills >= 6) & (c("_known") >= 3), skills > 0),
        check("education", 5, c("_studies") > 0, yes),
        check("length", 5, c("pages") <= 2, yes),
        check("characters", 3, c("_lost") == 0, yes),
    ]
    judged = facts.withColumn("checks", F.array_compact(F.array(*checks)))

    def weigh(amount) -> Column:
        return F.aggregate(F.transform("checks", amount), F.lit(0.0), lambda a, x: a + x)

    credit = weigh(lambda k: k["weight"] * F.when(k["status"] == "pass", 1.0).when(k["status"] == "warn", 0.5).otherwise(0.0))
    total = weigh(lambda k: k["weight"].cast("double"))
    judged = judged.withColumn("score", F.floor(credit / total * 100 + 0.5).cast("int"))
    verdict = (
        F.when(c("score") >= 85, "Ready to send").when(c("score") >= 70, "Nearly there").when(c("score") >= 45, "Needs work")
        .otherwise("Not ready yet")
    )
    return judged.withColumn("verdict", verdict).select(*resumes.columns, "checks", "score", "verdict", "recognised_skills", "pages")


def review_checks(reviewed: DataFrame) -> DataFrame:
    """(user_id, id, status, weight, score, verdict): one row per check."""
    # Every resume has checks. A plain inline would put a filter on them in front, which works all of them out twice.
    return reviewed.select("user_id", "score", "verdict", F.inline_outer("checks"))


# ------------------------------------------------------------------ hints

def bullet_hints(bullet: Column) -> Column:
    """array<struct<kind, text>> for one trimmed bullet, most important first."""

    def read(text: Column) -> Column:
        opener = None
        for pattern, better in WEAK_OPENERS:
            words = F.concat(
                F.lit("“"), F.regexp_extract(text, pattern, 0), F.lit(f"” says you were near the work. Try {better}.")
            )
            opener = F.when(text.rlike(pattern), words) if opener is None else opener.when(text.rlike(pattern), words)
        opener = (
            opener.when(text.rlike(r"(?i)^i\b"), "Drop the “I” and start with the verb.")
            .when(~starts_with_verb(text), "Start with what you did — Built, Led, Cut, Shipped.")
        )
        number = F.when(~has_number(text), "Add a number if you have one: users, %, ₹, time saved, team size.")
        n = F.length(text)
        size = F.when(
            n > LONG_BULLET, F.concat(n.cast("string"), F.lit(" characters — past two lines. Split it into two results."))
        ).when(n < SHORT_BULLET, "Short. Say what came of it.")

        def hint(kind: str, words: Column) -> Column:
            return F.when(words.isNotNull(), F.struct(F.lit(kind).alias("kind"), words.alias("text")))

        found = F.array_compact(F.array(hint("opener", opener), hint("number", number), hint("length", size)))
        return F.when(text != "", found).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))

    return bind(F.trim(F.coalesce(bullet, F.lit(""))), read)


def bullet_list_hints(resumes: DataFrame) -> DataFrame:
    """(user_id, section, entry, line, kind, text). Once half of an entry's bullets carry a
    number the nudge for one is dropped."""

    def section(name: str) -> Column:
        return F.transform(name, lambda e: F.struct(F.lit(name).alias("section"), F.coalesce(e["bullets"], _empty()).alias("bullets")))

    entries = resumes.select("user_id", F.explode(F.array(section("experience"), section("projects"))).alias("s"))
    entries = entries.select("user_id", F.posexplode("s").alias("entry", "e"))
    written = F.filter("e.bullets", lambda b: F.trim(b) != "")
    enough = (F.size(written) > 0) & (F.size(F.filter(written, has_number)) * 2 >= F.size(written))
    lines = entries.select("user_id", "entry", "e.section", enough.alias("_enough"), F.posexplode("e.bullets").alias("line", "bullet"))
    hints = lines.select("user_id", "section", "entry", "line", "_enough", F.inline(bullet_hints(F.col("bullet"))))
    return hints.filter(~(F.col("_enough") & (F.col("kind") == "number"))).drop("_enough")


def _date_value(text: Column) -> Column:
    """A month or year as months since year 0; null for anything else."""
    value = F.trim(F.coalesce(text, F.lit("")))
    year = _number(F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?$", 1))
    month = _number(F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?$", 2))
    return year * 12 + F.coalesce(month, F.lit(1)) - 1


def section_hints(resumes: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, field, tone, text) for the headline, summary, skills, roles and studies."""

    def hint(field: Column, tone: str, text: Column, when: Column) -> Column:
        return F.when(when, F.struct(field.alias("field"), F.lit(tone).alias("tone"), text.alias("text")))

    headline, summary = F.trim("headline"), F.trim("summary")
    skills = _kept(F.col("skills"))
    long_skill = F.try_element_at(F.filter(skills, lambda s: F.length(s) > 30), F.lit(1))
    n, size = F.size(skills), F.length(summary)
    top = [
        hint(F.lit("headline"), "fail", F.lit("Name the role you want, the way a posting would title it."), headline == ""),
        hint(F.lit("headline"), "warn", F.lit("Shorten this to the job title itself."), F.length(headline) > 70),
        hint(F.lit("summary"), "warn", F.concat(size, F.lit(" characters. Two or three lines is about 150–400.")), size.between(1, 119)),
        hint(F.lit("summary"), "warn", F.concat(size, F.lit(" characters. Cut it back to three lines.")), size > 700),
        hint(F.lit("summary"), "warn", F.lit("Resumes skip “I” and “my”: “Backend engineer with six years…”."),
             size.between(120, 700) & summary.rlike(r"(?i)\b(i am|i'm|my)\b") & summary.rlike(r"(?i)^(i|my)\b")),
        hint(F.lit("skills"), "warn", F.concat(n, F.lit(" listed. Six to fifteen is the right number.")), n.between(1, 5)),
        hint(F.lit("skills"), "warn", F.concat(n, F.lit(" listed. Keep the ones this role needs.")), n > 20),
        hint(F.lit("skills"), "warn", F.concat(F.lit("“"), F.substring(long_skill, 1, 30), F.lit("…” reads as a sentence. Keep each skill to a name.")),
             n.between(6, 20) & long_skill.isNotNull()),
    ]
    now = F.year(as_of) * 12 + F.month(as_of) - 1

    def role(e: Column, i: Column) -> Column:
        at = F.concat(F.lit("experience-"), i)
        begin, finish = clean(e["start"]), clean(e["end"])
        open_end = F.coalesce(e["current"], F.lit(False))
        since, until = _date_value(e["start"]), F.when(~open_end, _date_value(e["end"]))
        written = F.size(_kept(e["bullets"]))
        dates = (
            hint(F.concat(at, F.lit("-dates")), "fail", F.lit("Add a start date. A role without dates reads as a gap."), begin == ""),
            hint(F.concat(at, F.lit("-dates")), "fail", F.lit("Add an end date, or tick “I still work here”."), ~open_end & (finish == "")),
            hint(F.concat(at, F.lit("-dates")), "fail", F.lit("The end date is before the start date."), until < since),
            hint(F.concat(at, F.lit("-dates")), "warn", F.lit("The start date is in the future."), since > now + 1),
        )
        lines = F.coalesce(
            hint(F.concat(at, F.lit("-bullets")), "fail",
                 F.lit("Add what you did here, one bullet per line. Three to five is the shape recruiters read."), written == 0),
            hint(F.concat(at, F.lit("-bullets")), "warn", F.lit("One bullet. Add one or two more results from this role."), written == 1),
            hint(F.concat(at, F.lit("-bullets")), "warn", F.concat(written, F.lit(" bullets. Keep the best five; the rest dilute them.")), written > 6),
        )
        shown = F.array_compact(F.array(F.coalesce(*dates), lines))
        return F.when((clean(e["role"]) != "") | (clean(e["company"]) != ""), shown)

    def study(e: Column, i: Column) -> Column:
        at = F.concat(F.lit("education-"), i)
        end, detail = clean(e["end"]), clean(e["detail"])
        shown = F.array_compact(
            F.array(
                hint(F.concat(at, F.lit("-end")), "warn", F.lit("Add the year you finished, or expect to."), end == ""),
                F.coalesce(
                    hint(F.concat(at, F.lit("-detail")), "warn", F.lit("Add your CGPA (8.2/10) or percentage (78%) if it helps you."), detail == ""),
                    hint(F.concat(at, F.lit("-detail")), "warn", F.lit("Say what the number is: “CGPA 8.2/10” or “78%”."),
                         detail.rlike(r"^\d{1,2}(\.\d+)?$")),
                ),
            )
        )
        return F.when((clean(e["degree"]) != "") | (clean(e["institution"]) != ""), shown)

    hints = F.concat(
        F.array_compact(F.array(*top)),
        F.flatten(F.array_compact(F.transform("experience", role))),
        F.flatten(F.array_compact(F.transform("education", study))),
    )
    return resumes.select("user_id", F.inline(hints))


# ------------------------------------------------------------------ keyword gap

def _title_words(title: Column) -> Column:
    words = F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9+#.]+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(TITLE_FILLER))


def _mentions(text: Column, keyword: Column) -> Column:
    """The keyword as a whole word of lower-cased text, punctuation of names like C++ respected.

    A pattern that is not constant is compiled for each pair: only texts that hold the keyword reach it.
    """
    return F.contains(text, F.lower(keyword)) & F.rlike(text, F.concat(F.lit(r"(^|[^a-z0-9+#.])\Q"), F.lower(keyword), F.lit(r"\E($|[^a-z0-9+#])")))


def resume_side(resumes: DataFrame) -> DataFrame:
    """What of a resume is compared, worked out once per resume rather than once per pair."""
    skills = F.array_join("skills", ", ")
    names = F.concat(
        F.transform("experience", lambda e: e["role"]),
        F.transform("projects", lambda p: p["name"]),
        F.transform("certifications", lambda c: c["name"]),
    )
    everything = F.concat_ws("\n", "headline", "summary", skills, names, all_bullets())
    base = resumes.select("user_id", "headline", everything.alias("_all"), skills.alias("_line"))
    lower = lambda t: F.lower(t)
    return base.select(
        "user_id",
        F.lower("_all").alias("all_text"),
        F.lower("_line").alias("skills_text"),
        F.transform(extract_tags(F.col("headline"), F.col("_all")), lower).alias("found"),
        F.transform(extract_tags(F.lit(""), F.col("_line")), lower).alias("in_skills"),
        _title_words(F.col("headline")).alias("headline_words"),
    )


def job_side(jobs: DataFrame) -> DataFrame:
    """A job's keywords: its tags, then what its text names."""
    tags = F.concat("tags", extract_tags(F.col("title"), F.col("description")))
    return jobs.select("id", distinct_ignoring_case(tags).alias("keywords"), _title_words(F.col("title")).alias("title_words"))


def keyword_gap(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """For (user_id, id) pairs: keywords, matched, missing, not_in_skills, coverage, title_matches."""
    # The text rules run for the jobs and resumes that are in a pair, however many others there are.
    asked_jobs = jobs.join(pairs.select("id").distinct(), "id", "left_semi")
    asked_resumes = resumes.join(pairs.select("user_id").distinct(), "user_id", "left_semi")
    df = pairs.join(job_side(asked_jobs), "id").join(resume_side(asked_resumes), "user_id")
    present = lambda k: F.array_contains("found", F.lower(k)) | _mentions(F.col("all_text"), k)
    listed = lambda k: F.array_contains("in_skills", F.lower(k)) | _mentions(F.col("skills_text"), k)
    df = df.withColumn("matched", F.filter("keywords", present))
    asked, got = F.size("keywords"), F.size("matched")
    shared = F.size(F.filter("title_words", lambda w: F.array_contains("headline_words", w)))
    return df.select(
        "user_id",
        "id",
        "keywords",
        "matched",
        F.array_except("keywords", "matched").alias("missing"),
        F.filter("matched", lambda k: ~listed(k)).alias("not_in_skills"),
        F.when(asked == 0, 100).otherwise(F.floor(got * 100.0 / asked + 0.5)).cast("int").alias("coverage"),
        ((F.size("title_words") == 0) | (shared * 2 >= F.size("title_words"))).alias("title_matches"),
    )


# ------------------------------------------------------------------ starting and merging

EXPERIENCE_TYPE = (
    "array<struct<role:string,company:string,location:string,start:string,`end`:string,current:boolean,bullets:array<string>>>"
)
PROJECT_TYPE = "array<struct<name:string,link:string,bullets:array<string>>>"
EDUCATION_TYPE = "array<struct<degree:string,institution:string,location:string,start:string,`end`:string,detail:string>>"
CERTIFICATION_TYPE = "array<struct<name:string,issuer:string,year:string>>"
SECTIONS = {
    "experience": (EXPERIENCE_TYPE, ["role", "company"], "role"),
    "projects": (PROJECT_TYPE, ["name"], "project"),
    "education": (EDUCATION_TYPE, ["degree", "institution"], "qualification"),
    "certifications": (CERTIFICATION_TYPE, ["name"], "certification"),
}


def starter_resume(profiles: DataFrame) -> DataFrame:
    """A first resume from a profile: its title, skills and highest qualification."""
    degree, institution = clean(F.col("degree")), clean(F.col("institution"))
    study = F.array(
        F.struct(
            degree.alias("degree"),
            institution.alias("institution"),
            F.lit("").alias("location"),
            F.lit("").alias("start"),
            F.coalesce(F.col("graduation_year").cast("string"), F.lit("")).alias("end"),
            F.lit("").alias("detail"),
        )
    )
    return profiles.select(
        "user_id",
        F.trim(F.coalesce("current_title", F.lit(""))).alias("headline"),
        F.lit("").alias("summary"),
        F.coalesce("skills", _empty()).alias("skills"),
        F.array().cast(EXPERIENCE_TYPE).alias("experience"),
        F.array().cast(PROJECT_TYPE).alias("projects"),
        F.when((degree != "") | (institution != ""), study).otherwise(F.array().cast(EDUCATION_TYPE)).alias("education"),
        F.array().cast(CERTIFICATION_TYPE).alias("certifications"),
    )


def resume_workspace(users: DataFrame, profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Contact from the profile (the name falls back to the account's), content from the stored
    document, else started from the profile."""
    contact = ["phone", "city", "linkedin_url", "github_url", "portfolio_url"]
    people = users.select(F.col("id").alias("user_id"), F.col("name").alias("_name"), "email").join(
        profiles.select("user_id", "full_name", *contact), "user_id", "left"
    )
    content = ["headline", "summary", "skills", *SECTIONS]
    started = people.select("user_id").join(starter_resume(profiles), "user_id", "left")
    first = started.select("user_id", F.struct(*content).alias("_first"))
    stored = documents.select("user_id", F.struct(*content).alias("_stored"))
    name = F.coalesce(F.when(F.trim("full_name") != "", F.trim("full_name")), "_name")
    both = people.join(first, "user_id").join(stored, "user_id", "left").withColumn("_content", F.coalesce("_stored", "_first"))
    return both.select("user_id", name.alias("full_name"), "email", *contact, "_content.*")


def merge_resumes(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported content laid over what is written: only empty parts are filled, skills are
    added to. `changed` lists what was, in words."""
    a, b = current.alias("a"), imported.alias("b")
    joined = a.join(b, F.col("a.user_id") == F.col("b.user_id"))

    def count(n: Column, noun: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))

    def filled(side: str, name: str) -> Column:
        fields = SECTIONS[name][1]

        def any_filled(e: Column) -> Column:
            condition = F.lit(False)
            for field in fields:
                condition = condition | (clean(e[field]) != "")
            return condition

        return F.filter(F.col(f"{side}.{name}"), any_filled)

    out, changes = [F.col("a.user_id").alias("user_id")], []
    for name, words in (("headline", "target role"), ("summary", "summary")):
        take = (F.trim(F.col(f"a.{name}")) == "") & (F.col(f"b.{name}") != "")
        out.append(F.when(take, F.col(f"b.{name}")).otherwise(F.col(f"a.{name}")).alias(name))
        changes.append(F.when(take, F.lit(words)))
    skills = union_skills(F.col("a.skills"), F.col("b.skills"))
    more = F.size(skills) - F.size("a.skills")
    out.append(F.when(more > 0, skills).otherwise(F.col("a.skills")).alias("skills"))
    changes.append(F.when(more > 0, count(more, "skill")))
    for name, (_, _, noun) in SECTIONS.items():
        incoming = filled("b", name)
        take = (F.size(incoming) > 0) & (F.size(filled("a", name)) == 0)
        out.append(F.when(take, incoming).otherwise(F.col(f"a.{name}")).alias(name))
        changes.append(F.when(take, count(F.size(incoming), noun)))
    return joined.select(*out, F.array_compact(F.array(*changes)).alias("changed"))
