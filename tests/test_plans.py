"""Invariants and brute-force checks of the composite jobs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rolecall.operators import similarity, sort
from rolecall.operators.components import connected_components
from rolecall.operators.overlap import overlap_counts
from rolecall.operators.percentiles import exact_percentiles
from rolecall.operators.windows import number_rows
from rolecall.plans import dedupe, recommend, search, sync
from rolecall.operators.filters import SearchParams


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, 5000 + i) for i in range(1, 200)]  # a hub
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == union_find(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    return len(a & b) / (len(a | b) or 1)


def word_sets(rng):
    """Copies, chains of near copies, a hot block of them, and unrelated sets."""
    base = [f"w{i}" for i in range(60)]
    sets = []
    for block in ("hot", "b", "c"):
        n = 90 if block == "hot" else 15
        template = set(rng.sample(base, 40))
        for _ in range(n):
            words = set(template)
            for _ in range(rng.randrange(0, 4)):
                words.discard(rng.choice(sorted(words)))
                words.add(rng.choice(base))
            sets.append((block, words))
        sets += [(block, set(rng.sample(base, rng.randrange(1, 30)))) for _ in range(n // 3)]
    sets += [("hot", set()), ("hot", set())]
    return sets


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_links_match_brute_force(spark, seed):
    sets = word_sets(random.Random(seed))
    rows = [(i, block, sorted(words)) for i, (block, words) in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, block string, words array<string>")
    links = similarity.similar_links(df)
    got = {r["node"]: r["root"] for r in connected_components(links, "x", "y").collect()}
    pairs = [
        (i, j)
        for (i, (a, x)), (j, (b, y)) in itertools.combinations(enumerate(sets), 2)
        if a == b and jaccard(x, y) >= 0.9
    ]
    assert got == union_find(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_match_sorting(spark, seed):
    rng = random.Random(seed)
    values = {"hot": [rng.randrange(0, 5000) / 2 for _ in range(3000)], "one": [7.0], "two": [1.0, 4.0], "same": [3.5] * 50}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], F.col("v"), {"p25": 0.25, "p50": 0.5, "p75": 0.75}, 100).collect()}
    for g, vs in values.items():
        vs = sorted(vs)
        for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            at = p * (len(vs) - 1)
            lo = int(at)
            want = vs[lo] + (vs[min(lo + 1, len(vs) - 1)] - vs[lo]) * (at - lo)
            assert got[g][name] == pytest.approx(want)
        assert got[g]["n"] == len(vs)


def test_rows_are_numbered_without_a_group_in_one_task(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(2_000)) for _ in range(3_000)] + [("same", 7)] * 500 + [(f"g{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    numbered = number_rows(df, ["g"], ["v"], "n").collect()
    for g in ("hot", "same", "g3"):
        mine = sorted((r["n"], r["v"]) for r in numbered if r["g"] == g)
        assert mine == list(enumerate(sorted(v for x, v in rows if x == g)))
    assert number_rows(df.limit(0), ["g"], ["v"], "n").count() == 0


# ------------------------------------------------------------------ ordering and paging

JOB = (
    "id string, posted_at timestamp, salary_disclosed boolean, currency string, salary_min long, salary_max long, "
    "status string, featured boolean"
)


def job_rows():
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    rng = random.Random(4)
    rows = []
    for i in range(40):
        currency = rng.choice(["INR", "USD", "GBP", "EUR", None])
        band = (100 * rng.randrange(1, 4), 100 * rng.randrange(4, 6)) if currency and rng.random() < 0.9 else (None, None)
        rows.append((f"job{i:08d}", day(rng.randrange(1, 4)), currency is not None, currency, *band, "ACTIVE", False))
    return rows


@pytest.mark.parametrize("order", sort.SORTS)
@pytest.mark.parametrize("size", [1, 7, 39])
def test_paging_equals_full_order(spark, order, size):
    jobs = spark.createDataFrame(job_rows(), JOB).cache()
    full = [r["id"] for r in jobs.orderBy(*sort.order_by(order)).collect()]
    cursors = [full[i] for i in range(size - 1, len(full), size)]
    for cursor in cursors[:6]:
        found = search.search_jobs(jobs, None, SearchParams(), order, cursor, size)
        at = full.index(cursor) + 1
        assert [r["id"] for r in found.rows.orderBy("pos").collect()] == full[at : at + size]
        summary = found.summary.first()
        assert summary["total"] == len(full)
        assert summary["next_cursor"] == (full[at + size - 1] if at + size < len(full) else None)


@pytest.mark.parametrize("few", [20_000, 2])
def test_searches_from_a_table_equal_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_SEARCHES", few)
    rng = random.Random(6)
    base = [r + (rng.choice([1, 2, 3]), f"{rng.choice(['data', 'Ä-web', 'x'])} engineer {rng.choice(['acme', 'zed'])}".lower(), rng.choice(["DATA", "DESIGN"]),
                 rng.choice(["MID", "SENIOR", "INTERN"]), rng.choice(["REMOTE", "ONSITE"]), rng.choice([None, 0, 3, 9]), rng.choice([None, 4, 12]),
                 rng.choice(["Pune", "Navi Mumbai", "New Delhi"]), rng.choice([None, "India"]), rng.choice([["SQL"], ["Go", "SQL"], [], None]), rng.choice(["FULL_TIME", None])) for r in job_rows() * 1]
    base = [(*r[:6], rng.choice(["ACTIVE", "ACTIVE", "EXPIRED"]), *r[7:]) for r in base]
    extra = ", company_id long, search_text string, discipline string, level string, remote string, experience_min int, experience_max int, location string, remote_region string, tags array<string>, employment_type string"
    jobs = spark.createDataFrame(base, JOB + extra).cache()
    companies = spark.createDataFrame([(1, "SAAS"), (2, "FINTECH"), (3, None)], "id long, industry string")
    options = {
        "q": [None, None, "engineer", " data  acme ", "ä-", "zz", "x"], "location": [None, None, "Remote", "mumbai", "INDIA", "de"], "remote": [None, "REMOTE"],
        "discipline": [None, "DATA"], "level": [None, "MID", "SENIOR"], "exp": [None, None, "0-1", "3-5", "8-plus"], "industry": [None, None, "SAAS"], "currency": [None, None, "INR", "USD"],
        "min_salary": [None, 0, 300], "tag": [None, None, "SQL"], "city": [None, None, "Delhi"], "salary": [None, "1"], "employment_type": [None, None, "FULL_TIME"],
        "sort": [None, "newest", "salary"], "cursor": [None, None, "job00000007", "job99999999"],
    }
    asked = [{name: rng.choice(values) for name, values in options.items()} for _ in range(25)] + [dict.fromkeys(options)] * 2
    kinds = ", ".join(f"{name} {'long' if name == 'min_salary' else 'string'}" for name in options)
    searches = spark.createDataFrame([(i, *a.values()) for i, a in enumerate(asked)], f"search_id int, {kinds}")
    got = {}
    for r in search.search_table(jobs, companies, searches, 5).orderBy("pos").collect():
        got.setdefault(r["search_id"], ([], r["total"]))[0].append(r["id"])
    for i, a in enumerate(asked):
        params = SearchParams(**{k: bool(v) if k == "salary" else v for k, v in a.items() if k not in ("sort", "cursor") and v is not None})
        page = search.match_page(jobs, companies, params, a["sort"] or "recommended", a["cursor"], 5).first()
        assert got.get(i, ([], page["total"] if not page["page"] else 0)) == (page["page"], page["total"]), a
    assert search.search_table(jobs, companies, searches.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_counts_each_pair_once(spark, seed):
    rng = random.Random(seed)
    skills = [f"s{i}" for i in range(9)]

    def some(most):
        return rng.choice([None, [], [None, "s0", "s0"]]) if rng.random() < 0.1 else [skills[min(8, int(rng.expovariate(0.5)))] for _ in range(rng.randrange(most))]

    people, roles = [(i, some(5)) for i in range(300)], [(i, some(7)) for i in range(120)]
    kinds = "id long, values array<string>"
    got = {r["id"]: r["n"] for r in overlap_counts(spark.createDataFrame(people, kinds), "values", spark.createDataFrame(roles, kinds), "values", "n").collect()}
    assert got == {i: sum(bool(set(x or []) & set(y or []) - {None}) for _, y in people) for i, x in roles}


# ------------------------------------------------------------------ merging and syncing

LISTING = (
    "company_id long, source string, external_id string, title string, description string, discipline string, level string, "
    "employment_type string, tags array<string>, location string, remote string, remote_region string, salary_min long, "
    "salary_max long, experience_min int, experience_max int, apply_url string, posted_at timestamp, "
    "role struct<requisition_id:string,department:string,classification:string>, content_hash string"
)


def listing(i, title="Engineer", city="Pune", text="a " * 3 + "long shared text about building data tools", req=None, day=5):
    import datetime

    return (
        1, "LEVER", f"x{i:03d}", title, text, "DATA", "MID", "FULL_TIME", ["SQL"], city, "ONSITE", None, None, None, None, None,
        "https://x/", datetime.datetime(2024, 1, day), (req, None, None), "h",
    )


def test_dedupe_is_transitive_and_order_free(spark):
    words = [f"word{i}" for i in range(40)]
    rows = [
        listing(1, city="Pune", text=" ".join(words)),
        listing(2, city="Mumbai", text=" ".join(words[1:] + ["extra"]), day=3),
        listing(3, city="India", text=" ".join(words), req="R1"),
        listing(4, "Sr. Engineer - Pune", city="Kochi", text="other", req="R1"),  # another title: not merged
        listing(5, "Engineer, Delhi", city="Delhi · Noida", text="nothing alike", req="R1"),
        listing(6, "Engineer", text="See the full description on the company's careers page."),
        listing(7, "Engineer", text="See the full description on the company's careers page."),
    ]
    want = {("x001", "Pune · Mumbai · Delhi · Noida", 4), ("x004", "Kochi", 1), ("x006", "Pune", 1), ("x007", "Pune", 1)}
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, LISTING).repartition(5)
        merged = dedupe.dedupe_postings(df).collect()
        assert {(r["external_id"], r["location"], r["group_size"]) for r in merged} == want
    listed = spark.createDataFrame([(1, "LEVER", "x005", True), (1, "LEVER", "x002", False)], "company_id long, source string, external_id string, active boolean")
    kept = dedupe.dedupe_postings(spark.createDataFrame(rows, LISTING), listed).filter("group_size = 4").first()
    assert (kept["external_id"], kept["location"]) == ("x005", "Delhi · Noida · Mumbai · Pune")


def test_sync_twice_only_confirms(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    columns = "company_id long, source string, external_id string, status string, title string, content_hash string, posted_at timestamp, last_verified_at timestamp"
    stored = spark.createDataFrame(
        [(1, "LEVER", "a", "ACTIVE", "A", "h1", None, None), (1, "LEVER", "b", "ACTIVE", "B", "h2", None, None),
         (1, "MANUAL", None, "ACTIVE", "M", None, None, None)],
        columns,
    )
    incoming = spark.createDataFrame(
        [(1, "LEVER", "a", "A2", "h9", True, False, True), (1, "LEVER", "c", "C", "h3", False, False, True)],
        "company_id long, source string, external_id string, title string, content_hash string, salary_disclosed boolean, list_only boolean, detail_ready boolean",
    ).withColumn("posted_at", as_of)
    feeds = spark.createDataFrame([(1, "LEVER", True, None, 2)], "company_id long, source string, ok boolean, error string, fetched long")
    planned = sync.plan_sync(stored, incoming, feeds)
    assert {r["external_id"]: r["action"] for r in planned.filter("action is not null").collect()} == {"a": "update", "b": "expire", "c": "create"}
    table = sync.apply_sync(planned, stored, incoming, as_of)
    assert {(r["external_id"], r["status"], r["title"]) for r in table.collect()} == {
        ("a", "ACTIVE", "A2"), ("b", "EXPIRED", "B"), ("c", "ACTIVE", "C"), (None, "ACTIVE", "M"),
    }
    again = sync.plan_sync(table, incoming, feeds).filter("action is not null").collect()
    assert {r["external_id"]: r["action"] for r in again} == {"a": "confirm", "c": "confirm"}


def test_all_landed_details_are_created(spark):
    stored = spark.createDataFrame([], "company_id long, source string, external_id string, status string, content_hash string")
    rows = [(1, "ORACLE", f"e{i:03d}", "h", False, True, i != 0) for i in range(300)]
    incoming = spark.createDataFrame(
        rows, "company_id long, source string, external_id string, content_hash string, salary_disclosed boolean, list_only boolean, detail_ready boolean"
    )
    feeds = spark.createDataFrame([(1, "ORACLE", True, None, 300)], "company_id long, source string, ok boolean, error string, fetched long")
    got = {r["external_id"]: r["action"] for r in sync.plan_sync(stored, incoming, feeds).collect()}
    assert got == {f"e{i:03d}": "create" if i else "pending" for i in range(300)}


def test_backfill_is_idempotent(spark):
    jobs = spark.createDataFrame(
        [("a", "Dev", "3-5 years of experience", "ACTIVE", "LEVER", None, None), ("b", "Dev", "no figure", "ACTIVE", "LEVER", None, None),
         ("c", "Dev", "3 years of experience", "EXPIRED", "LEVER", None, None)],
        "id string, title string, description string, status string, source string, experience_min int, experience_max int",
    )
    first = sync.backfill_experience(jobs)
    assert [(r["id"], r["experience_min"], r["experience_max"]) for r in first.collect()] == [("a", 3, 5)]
    assert sync.backfill_experience(first).count() == 0


# ------------------------------------------------------------------ matching

def test_pools_of_busy_candidates(spark):
    """Applications must not eat into a pool, for usual and for very busy candidates."""
    import datetime

    rng = random.Random(9)
    skills, levels = ["a", "b", "c"], ["JUNIOR", "MID", "SENIOR"]
    jobs = [
        (f"j{i:03d}", datetime.datetime(2024, 1, 1 + i % 20), rng.sample(skills, rng.randrange(1, 3)), rng.choice(levels),
         rng.choice(["ACTIVE", "ACTIVE", "EXPIRED"]))
        for i in range(80)
    ]
    people = [(u, rng.sample(skills, rng.randrange(0, 3)), rng.choice([None, 0, 1, 4])) for u in range(12)]
    applied = {(u, rng.choice(jobs)[0]) for u in range(12) for _ in range(30 if u < 3 else 2)}
    got = {}
    pools = recommend.match_pools(
        spark.createDataFrame(people, "user_id long, skills array<string>, years_experience int"),
        spark.createDataFrame(jobs, "id string, posted_at timestamp, tags array<string>, level string, status string"),
        spark.createDataFrame(sorted(applied), "user_id long, job_id string"),
        pool=5,
    )
    for r in pools.collect():
        got.setdefault(r["user_id"], set()).add(r["id"])
    fits = {None: levels, 0: ["INTERN", "JUNIOR"], 1: ["JUNIOR", "MID"], 4: ["MID", "SENIOR"]}
    for user, wanted, years in people:
        fit = [
            (posted, i) for i, posted, tags, level, status in jobs
            if status == "ACTIVE" and set(tags) & set(wanted) and level in fits[years] and (user, i) not in applied
        ]
        assert got.get(user, set()) == {i for _, i in sorted(fit, reverse=True)[:5]}


def test_sets_of_a_group_are_equal_in_a_segment(spark):
    """A shared word, however rare, is no reason to compare two sets; sets over the threshold always meet."""
    rng = random.Random(11)
    far = [(f"far{i}", "b", [f"{i}-{k}" for k in range(30)] + ["shared"]) for i in range(40)]
    near = []
    for i in range(120):
        n = rng.randrange(19, 400)
        one = [f"n{i}-{k}" for k in range(n)]
        most = 2 * n // 19
        gone = rng.randrange(most + 1)
        near += [(f"near{i}x", "b", one), (f"near{i}y", "b", one[gone:] + [f"new{i}-{k}" for k in range((2 * n - gone) // 19 - gone)])]
    sets = spark.createDataFrame(far + near, "item string, block string, words array<string>")
    items = sets.select("item", "block", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    members = similarity._groups(items).filter("item NOT LIKE 'far%'").count()
    assert similarity._groups(items).filter("item LIKE 'far%'").count() == 0 < members
    words = {name: set(held) for name, _, held in near}
    want = {(f"near{i}x", f"near{i}y") for i in range(120)}
    want = {(x, y) for x, y in want if words[x] != words[y] and 10 * len(words[x] & words[y]) >= 9 * len(words[x] | words[y])}
    links = {tuple(sorted(r)) for r in similarity.similar_links(sets.withColumnRenamed("item", "id")).collect()}
    assert want <= links and len(want) > 60
