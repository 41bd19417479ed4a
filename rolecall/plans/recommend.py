"""Open roles for every candidate at once, ranked with reasons.

A candidate's pool is the newest `pool` roles that share a skill and sit at a
fitting level, without roles already applied to. Joining candidates to every
such role would grow with the product of the two tables. A role can only be in
a pool if it is among the newest of one of its (skill, level) lists, so lists
are cut to `pool` before anything is joined. Candidates who ask for the same share a
profile: lists are merged, and what does not depend on the single candidate is
judged, once for each profile. The few whose own applications leave their pool short
read deeper lists in rounds of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rolecall.functions.display_text import format_inr_short
from rolecall.functions.text import bind
from rolecall.operators.filters import is_active
from rolecall.session import cut_lineage

POOL = 150
#: Profiles whose lists are broadcast, 50 kB each; the lists of more are joined by a shuffle of candidates.
FEW_PROFILES = 500
RESULTS = 12
ANY_LEVEL = "*"

# Years (up to and including) -> levels worth showing.
LEVELS_BY_YEARS = [
    (0, ["INTERN", "JUNIOR"]),
    (1, ["JUNIOR", "MID"]),
    (3, ["JUNIOR", "MID", "SENIOR"]),
    (6, ["MID", "SENIOR"]),
    (9, ["SENIOR", "STAFF", "MANAGER"]),
    (13, ["SENIOR", "STAFF", "PRINCIPAL", "MANAGER"]),
    (None, ["STAFF", "PRINCIPAL", "MANAGER", "DIRECTOR"]),
]
# Points.
SKILL, MOST_SKILLS, LEVEL, CITY, REMOTE, MEETS_PAY, SHOWS_PAY = 3, 4, 4, 3, 1, 4, 1


def levels_for(years: Column) -> Column:
    """Fitting levels; empty when the years are not known."""
    chosen = F.when(years.isNull(), F.array().cast("array<string>"))
    for upto, levels in LEVELS_BY_YEARS:
        names = F.array(*[F.lit(x) for x in levels])
        chosen = chosen.otherwise(names) if upto is None else chosen.when(years <= upto, names)
    return chosen


PERSON = ["skills", "years_experience", "city", "expected_salary"]
ROLE = ["tags", "level", "location", "remote", "salary_max", "currency"]


def _skill_reason(skills: Column) -> Column:
    n, first, second = F.size(skills), F.try_element_at(skills, F.lit(1)), F.try_element_at(skills, F.lit(2))
    return (
        F.when(n > 2, F.concat(first, F.lit(", "), second, F.lit(" and "), n - 2, F.lit(" more match")))
        .when(n == 2, F.concat(first, F.lit(" and "), second, F.lit(" match")))
        .when(n == 1, F.concat(first, F.lit(" matches")))
    )


def _pay_reason(pay: Column) -> Column:
    return F.concat(F.lit("Pays up to ₹"), format_inr_short(pay))


def _scored(role: Column, person: Column) -> Column:
    """struct(score, matched_skills, reasons) of one role (ROLE fields) for one person (PERSON fields)."""

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    def facts(wanted: Column) -> Column:
        has_city = F.length(F.coalesce(person["city"], F.lit(""))) > 0
        is_remote = has_city & (role["remote"] == "REMOTE")
        paid = F.coalesce((role["currency"] == "INR") & role["salary_max"].isNotNull(), F.lit(False))
        return F.struct(
            F.filter(role["tags"], lambda t: F.array_contains(wanted, F.lower(t))).alias("skills"),
            is_remote.alias("remote"),
            (has_city & ~is_remote & F.contains(F.lower(role["location"]), F.lower(person["city"]))).alias("near"),
            paid.alias("paid"),
            F.coalesce(paid & (role["salary_max"] >= person["expected_salary"]), F.lit(False)).alias("meets"),
            F.array_contains(levels_for(person["years_experience"]), role["level"]).alias("fits"),
        )

    def judge(f: Column) -> Column:
        skills, n = f["skills"], F.size(f["skills"])
        score = (
            F.least(n, F.lit(MOST_SKILLS)) * SKILL
            + points(f["fits"], LEVEL)
            + points(f["remote"], REMOTE)
            + points(f["near"], CITY)
            + points(f["paid"], SHOWS_PAY)
            + points(f["meets"], MEETS_PAY)
        )
        by_skill = _skill_reason(skills)
        place = F.when(f["remote"], F.lit("Remote")).when(f["near"], F.concat(F.lit("In "), person["city"]))
        pay = F.when(f["meets"], _pay_reason(role["salary_max"]))
        return F.struct(score.alias("score"), skills.alias("matched_skills"), F.array_compact(F.array(by_skill, place, pay)).alias("reasons"))

    return bind(bind(F.transform(person["skills"], lambda s: F.lower(s)), facts), judge)


def score_job(pairs: DataFrame) -> DataFrame:
    """Adds `score`, `matched_skills` and `reasons` to candidate-job rows, which have the PERSON and ROLE columns."""
    scored = _scored(F.struct(*ROLE), F.struct(*PERSON))
    return pairs.select("*", scored.alias("_s")).select(*pairs.columns, "_s.*")


def _newest_first(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.desc("posted_at"), F.desc("id"))


def _profiled(candidates: DataFrame, carried: list[str]) -> DataFrame:
    """(user_id, skills, levels, profile, *carried) of candidates with skills; those that ask for the same thing share a profile."""
    skills, levels = F.array_sort(F.array_distinct("skills")), levels_for(F.col("years_experience"))
    known = candidates.filter(F.size("skills") > 0).select("user_id", skills.alias("skills"), levels.alias("levels"), *carried)
    return known.withColumn("profile", F.sha2(F.to_json(F.struct("skills", "levels")), 256))


def _asks(people: DataFrame, by: str) -> DataFrame:
    """(by, skill, level): the lists that each of `people` reads."""
    levels = F.when(F.size("levels") > 0, F.col("levels")).otherwise(F.array(F.lit(ANY_LEVEL)))
    return people.select(by, F.explode("skills").alias("skill"), levels.alias("_l")).select(by, "skill", F.explode("_l").alias("level"))


def _lists(jobs: DataFrame, depth: int, facts: list[str]) -> DataFrame:
    """(skill, level, role, posted_at, id, _r): the newest `depth` roles of every (skill, level) and of every skill."""
    tagged = jobs.select(F.struct("posted_at", "id", *facts).alias("role"), "posted_at", "id", F.explode(F.array_distinct("tags")).alias("skill"), "level")
    both = tagged.select("role", "posted_at", "id", "skill", F.explode(F.array("level", F.lit(ANY_LEVEL))).alias("level"))
    # The depth is a constant, so tasks cut their lists before the shuffle.
    return both.withColumn("_r", F.row_number().over(_newest_first("skill", "level"))).filter(F.col("_r") <= depth)


def _merged_lists(known: DataFrame, jobs: DataFrame, facts: list[str], pool: int) -> DataFrame:
    """(profile, skills, levels, roles): for each profile its newest fitting roles, `pool` of them at most, newest first."""
    profiles = known.groupBy("profile").agg(F.any_value("skills").alias("skills"), F.any_value("levels").alias("levels"))
    lists = _lists(jobs, pool, facts).groupBy("skill", "level").agg(F.collect_list("role").alias("list"))
    merged = _asks(profiles, "profile").join(lists, ["skill", "level"]).groupBy("profile").agg(F.flatten(F.collect_list("list")).alias("all"))
    newest = F.slice(F.sort_array(F.array_distinct("all"), asc=False), 1, pool)
    return merged.select("profile", newest.alias("roles")).join(profiles, "profile")


def _deeper(short: DataFrame, jobs: DataFrame, applied: DataFrame, pool: int, facts: list[str]) -> DataFrame:
    """(user_id, roles) of candidates whose own applications left their pool short.

    They read lists of twice the depth, row by row, until a pool is full or its lists
    end; whoever is done leaves the rounds, so a busy candidate lengthens nobody's lists.
    """
    found, depth = None, pool
    while True:
        depth *= 2
        asks = _asks(short, "user_id")
        met = asks.join(_lists(jobs, depth, []), ["skill", "level"])
        cut = met.groupBy("user_id").agg(F.max("_r").alias("_longest"))
        # Of lists cut at `depth` only the newest `depth` roles together are sure to be the newest.
        sure = met.select("user_id", "posted_at", "id").distinct().withColumn("_p", F.row_number().over(_newest_first("user_id"))).filter(F.col("_p") <= depth)
        fresh = sure.join(applied, ["user_id", "id"], "left_anti").withColumn("_p", F.row_number().over(_newest_first("user_id"))).filter(F.col("_p") <= pool)
        fresh = cut_lineage(fresh.select("user_id", "posted_at", "id"))
        counts = fresh.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
        again = short.join(cut.filter(F.col("_longest") == depth), "user_id", "left_semi").join(counts, "user_id", "left").filter(F.coalesce("_n", F.lit(0)) < pool)
        again = cut_lineage(again.select(*short.columns))
        done = fresh.join(again, "user_id", "left_anti")
        found = done if found is None else found.unionByName(done)
        if again.isEmpty():
            break
        short = again
    roles = found.join(jobs.select("id", *facts), "id") if facts else found
    newest = F.sort_array(F.collect_list(F.struct("posted_at", "id", *facts)), asc=False)
    return roles.groupBy("user_id").agg(newest.alias("roles"))


def _pools(
    candidates: DataFrame, jobs: DataFrame, applications: DataFrame, pool: int, facts: list[str], judge: Callable[[Column, Column, Column], Column], carried: list[str]
) -> DataFrame:
    """(user_id, roles, *carried): each candidate's pool, newest first, as an array of structs.

    `judge(role, skills, levels)` makes a struct of a role (posted_at, id, *facts) for
    all candidates of one profile at once.
    """
    active = jobs.filter(is_active()).select(*dict.fromkeys(["id", "posted_at", "tags", "level", *facts]))
    applied = applications.select("user_id", F.col("job_id").alias("id")).distinct()
    known = _profiled(candidates, carried)

    def judged(people: DataFrame) -> DataFrame:
        return people.withColumn("roles", F.transform("roles", lambda r: judge(r, F.col("skills"), F.col("levels"))))

    # Written once: the candidates that need deeper lists are told from it, and all others are served from it.
    merged = cut_lineage(judged(_merged_lists(known, active, facts, pool)).select("profile", "roles"))
    done = applied.groupBy("user_id").agg(F.collect_list("id").alias("done"))
    few = merged.limit(FEW_PROFILES + 1).count() <= FEW_PROFILES
    # The wide lists come last: nothing is shuffled with them. Narrow rows with much work ahead are dealt to all tasks.
    parts = int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = known.join(done, "user_id", "left").repartition(parts, "user_id")
    first = people.join(F.broadcast(merged) if few else merged, "profile")
    ids = F.transform("roles", lambda r: r["id"])
    left = F.when(F.arrays_overlap(ids, "done"), bind(F.array_except(ids, "done"), lambda x: F.filter("roles", lambda r: F.array_contains(x, r["id"])))).otherwise(F.col("roles"))
    first = first.withColumn("_full", F.size("roles") == pool).withColumn("roles", F.coalesce(left, "roles"))
    is_short = F.col("_full") & (F.size("roles") < pool)
    short = cut_lineage(first.filter(is_short).select("user_id", "skills", "levels", *carried))
    whole = first.filter(~is_short).select("user_id", "roles", *carried)
    if short.isEmpty():
        return whole
    deeper = judged(_deeper(short, active, applied, pool, facts).join(short, "user_id"))
    return whole.unionByName(deeper.select("user_id", "roles", *carried))


def match_pools(candidates: DataFrame, jobs: DataFrame, applications: DataFrame, pool: int = POOL) -> DataFrame:
    """(user_id, id, posted_at) for every candidate with skills. Roles applied to do not eat into the pool."""
    pools = _pools(candidates, jobs, applications, pool, [], lambda role, skills, levels: role, [])
    return pools.select("user_id", F.inline("roles")).select("user_id", "id", "posted_at")


def _for_profile(role: Column, skills: Column, levels: Column) -> Column:
    """What all candidates of a profile have in common about a role: its points for skills, level and stated pay."""
    wanted = F.transform(skills, lambda s: F.lower(s))
    matched = F.filter(role["tags"], lambda t: F.array_contains(wanted, F.lower(t)))
    paid = F.when((role["currency"] == "INR") & role["salary_max"].isNotNull(), role["salary_max"])

    def points(m: Column) -> Column:
        base = F.least(F.size(m), F.lit(MOST_SKILLS)) * SKILL + F.when(F.array_contains(levels, role["level"]), LEVEL).otherwise(0) + F.when(paid.isNotNull(), SHOWS_PAY).otherwise(0)
        return F.struct(
            role["posted_at"].alias("posted_at"), role["id"].alias("id"), base.alias("base"), (role["remote"] == "REMOTE").alias("remote"),
            F.lower(role["location"]).alias("place"), paid.alias("paid"), m.alias("matched"), _skill_reason(m).alias("by_skill"),
        )

    return bind(matched, points)


def recommend_jobs(candidates: DataFrame, jobs: DataFrame, applications: DataFrame, k: int = RESULTS, pool: int = POOL) -> DataFrame:
    """(user_id, pos, id, score, matched_skills, reasons): the best `k` roles of each candidate's pool.

    Skills, level and stated pay are judged once per profile; a candidate's own row
    adds city and expected pay, and reasons are put into words for the `k` best only.
    """
    city = F.when(F.length("city") > 0, F.lower("city"))
    pools = _pools(candidates, jobs, applications, pool, ROLE, _for_profile, ["city", "expected_salary"]).withColumn("_city", city)
    at_home, near = (lambda r: F.col("_city").isNotNull() & r["remote"]), (lambda r: F.col("_city").isNotNull() & ~r["remote"] & F.contains(r["place"], F.col("_city")))

    def scored(r: Column) -> Column:
        own = F.when(at_home(r), REMOTE).when(near(r), CITY).otherwise(0) + F.when(r["paid"] >= F.col("expected_salary"), MEETS_PAY).otherwise(0)
        return F.struct((r["base"] + own).alias("score"), r["posted_at"].alias("posted_at"), r["id"].alias("id"), r.alias("role"))

    def worded(s: Column) -> Column:
        r = s["role"]
        place = F.when(at_home(r), F.lit("Remote")).when(near(r), F.concat(F.lit("In "), F.col("city")))
        pay = F.when(r["paid"] >= F.col("expected_salary"), _pay_reason(r["paid"]))
        return F.struct(s["id"].alias("id"), s["score"].alias("score"), r["matched"].alias("matched_skills"), F.array_compact(F.array(r["by_skill"], place, pay)).alias("reasons"))

    best = pools.select("user_id", "city", "_city", "expected_salary", F.slice(F.sort_array(F.transform("roles", scored), asc=False), 1, k).alias("_best"))
    return best.select("user_id", F.posexplode(F.transform("_best", worded)).alias("_p", "r")).select(
        "user_id", "r.id", "r.score", "r.matched_skills", "r.reasons", (F.col("_p") + 1).alias("pos")
    )


def matching_readiness(candidates: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Whether a profile can be matched, what it lacks, and what the home page shows."""
    ready = F.size("skills") > 0
    missing = F.array_compact(
        F.array(
            F.when(~ready, F.lit("your skills")),
            F.when(F.col("years_experience").isNull(), F.lit("your years of experience")),
        )
    )
    df = candidates.withColumn("ready", ready).withColumn("missing", missing)
    if matches is None:
        return df
    found = matches.select("user_id").distinct().withColumn("_found", F.lit(True))
    view = F.when(~F.col("ready"), "latest-nudge").when(F.col("_found"), "recommended").otherwise("latest")
    return df.join(found, "user_id", "left").withColumn("view", view).drop("_found")
