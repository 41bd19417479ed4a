"""Streams beside the batch jobs that they stand for."""

import datetime
import random

from pyspark.sql import functions as F

from rolecall.plans import sync
from rolecall.sources.buckets import FIRST, BucketTable, changed_by
from rolecall.streaming import expiry, streams

CONFIRMATION = "id string, source string, posted_at timestamp, verified_at timestamp"


def day(n, hours=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hours)


def test_timers_leave_what_the_batch_jobs_leave(spark, tmp_path):
    rng = random.Random(3)
    listings = [(f"job{i}", rng.choice(["LEVER", "ASHBY", "MANUAL"]), day(rng.randrange(-25, 20))) for i in range(60)]
    runs = [day(n) for n in (1, 4, 8, 15, 16, 22, 23)]
    landed = []
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], CONFIRMATION).schema
    changes = expiry.expiry_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for n, at in enumerate(runs):
        rows = [(i, source, posted, at) for i, source, posted in listings if posted <= at and rng.random() < 0.5]
        rows += [(None, "LEVER", at, at), ("no time", "LEVER", at, None)] + rows[:3]
        landed += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (2, len(runs) - 1):  # stopped and started again in between
            expiry.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    made = spark.read.schema(changes.schema).parquet(f"{tmp_path}/out")
    fresh = [r for r in landed if r[0] and r[3] and r[2] >= r[3] - datetime.timedelta(days=30)]
    table = {}
    for i, source, posted, at in fresh:
        table[i] = (i, "ACTIVE", source, table.get(i, (0, 0, 0, posted))[3], max(at, table.get(i, (0, 0, 0, 0, at))[4]))
    stored = spark.createDataFrame(list(table.values()), "id string, status string, source string, posted_at timestamp, last_verified_at timestamp")
    as_of = F.lit(max(r[3] for r in fresh)).cast("timestamp")
    want = {(r["id"], r["status"]) for r in sync.expire_unconfirmed(sync.purge_old(stored, as_of), as_of).collect()}
    got = expiry.listings_left(spark.createDataFrame(fresh, CONFIRMATION), made)
    assert {tuple(r) for r in got.collect()} == want
    assert len({s for _, s in want}) == 2 and len(want) < len(table)
    # A change is said once, and a listing that was taken down and confirmed again says both.
    assert made.count() == made.distinct().count()
    assert {"EXPIRED", "ACTIVE", "DELETED"} == {r["status"] for r in made.select("status").distinct().collect()}


def test_a_late_confirmation_moves_nothing_back(spark, tmp_path):
    batches = [[("a", "LEVER", day(0), day(10))], [("a", "LEVER", day(0), day(3)), ("b", "LEVER", day(9), day(10))], [("b", "LEVER", day(9), day(16))], [("b", "LEVER", day(9), day(18))]]
    for rows in batches:
        spark.createDataFrame(rows, CONFIRMATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(CONFIRMATION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes = expiry.expiry_changes(stream, "8 days")
    expiry.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert spark.read.schema(changes.schema).parquet(f"{tmp_path}/out").count() == 0  # the clock stands at day 10


# ------------------------------------------------------------------ bucketed tables

APPLICATION = "user_id long, job_id string, created_at timestamp, last_clicked_at timestamp, stage string"


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_batch_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    stored = spark.createDataFrame([(u, f"job{u % 7}", day(1), day(2), "OFFER") for u in range(1_000)], APPLICATION)
    table = streams.applications_table(stored, str(tmp_path / "table"))
    first = files(tmp_path / "table")
    clicks = spark.createDataFrame([(u, "job3", day(5)) for u in range(0, 50, 10)] + [(2_000 + u, "new", day(6)) for u in range(5)], "user_id int, job_id string, created_at timestamp")
    apply = changed_by(table, streams.upsert_applications)
    apply(clicks, 0)
    assert len(table.touched(clicks)) <= 10 < len(table.versions(0))
    assert {b for b, v in table.versions(0).items() if v == 0} == set(table.touched(clicks))
    assert first.items() <= files(tmp_path / "table").items()  # nothing else was written again
    want = sorted(map(tuple, streams.upsert_applications(stored, clicks).collect()))
    assert sorted(map(tuple, table.rows(0).collect())) == want
    apply(clicks, 0)  # a replay
    assert sorted(map(tuple, table.rows(0).collect())) == want
    apply(clicks.limit(0), 1)
    assert table.versions(1) == table.versions(0)
    apply(clicks, 2)  # the same rows again change nothing
    assert sorted(map(tuple, table.rows(2).collect())) == want
    assert table.rows(FIRST).count() == 1_000


def test_empty_tables_and_emptied_buckets(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v long")
    table = BucketTable(spark, str(tmp_path / "t"), empty.schema, ("k",), 4)
    table.start(empty)
    table.start(empty)
    assert table.rows(FIRST).count() == 0
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), ("b", 4)], empty.schema)
    table.change(0, table.touched(rows), rows)
    assert sorted(r["v"] for r in table.rows(0).collect()) == [1, 2, 3, 4]
    gone = rows.filter("k = 'a'")
    table.change(1, table.touched(gone), table.rows(0, table.touched(gone)).filter("k <> 'a'"))
    assert 2 not in {r["v"] for r in table.rows(1).collect()} and table.rows(0).count() == 4


def test_a_streamed_sync_waits_for_whole_runs_and_touches_their_feeds_only(spark, tmp_path):
    kinds = "run_id int, company_id long, source string, external_id string, title string, content_hash string, salary_disclosed boolean, list_only boolean, detail_ready boolean, posted_at timestamp"
    stored = spark.createDataFrame(
        [(c, "LEVER", f"x{i}", f"old {i}", "ACTIVE", "h", day(1), day(1)) for c in range(40) for i in range(5)],
        "company_id long, source string, external_id string, title string, status string, content_hash string, posted_at timestamp, last_verified_at timestamp",
    )

    def row(run, company, i, title="new", change="h2"):
        return (run, company, "LEVER", f"x{i}", title, change, False, False, True, day(2))

    runs = [(r, c, "LEVER", (r, c) != (1, 8), None, n, day(10 + r)) for r, c, n in ((1, 3, 3), (2, 3, 2), (3, 3, 2), (1, 8, 9), (2, 8, 1))]
    runs = spark.createDataFrame(runs, "run_id int, company_id long, source string, ok boolean, error string, fetched long, run_at timestamp")
    batches = [
        [row(1, 3, 0), row(1, 3, 1)],  # a part of a run: waits
        [row(1, 3, 9)],  # whole: x0, x1 changed, x9 new, x2 to x4 gone
        [row(2, 3, 0), row(3, 3, 0, "third", "h3"), row(3, 3, 9, "third", "h3"), row(1, 8, 1)],  # run 3 is whole and waits for run 2
        [row(2, 3, 1), row(2, 8, 4, "one", "h9")],  # runs 2 and 3 in order; company 8, whose run 1 failed, has one role left
    ]
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], kinds).schema
    tables = streams.sync_tables(stored, spark.createDataFrame([], schema), str(tmp_path / "tables"))
    jobs_versions = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = streams.stream_sync(arriving, runs, tables, f"{tmp_path}/log")
        run.awaitTermination()
        jobs_versions.append(tables.jobs.versions(run.lastProgress["batchId"]))
    changed = [sum(v == n for v in held.values()) for n, held in enumerate(jobs_versions)]
    assert changed[0] == changed[2] == 0 and all(n <= 2 for n in changed)
    got = {(r["company_id"], r["external_id"]): (r["status"], r["title"], r["last_verified_at"]) for r in streams.latest_version(tables.jobs, run).collect()}
    assert {k: v for k, v in got.items() if k[0] not in (3, 8)} == {(c, f"x{i}"): ("ACTIVE", f"old {i}", day(1)) for c in range(40) if c not in (3, 8) for i in range(5)}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {
        "x0": ("ACTIVE", "third", day(13)), "x9": ("ACTIVE", "third", day(13)), "x1": ("EXPIRED", "new", day(12)),
        "x2": ("EXPIRED", "old 2", day(1)), "x3": ("EXPIRED", "old 3", day(1)), "x4": ("EXPIRED", "old 4", day(1)),
    }
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 8} == {"x0": "EXPIRED", "x1": "EXPIRED", "x2": "EXPIRED", "x3": "EXPIRED", "x4": "ACTIVE"}
    assert tables.waiting.rows(run.lastProgress["batchId"]).count() == 0


def test_each_landed_run_is_one_batch_however_many_files_it_is(spark, tmp_path, monkeypatch):
    from rolecall.catalog import queries
    from rolecall.catalog import streams as registered

    monkeypatch.setattr(registered, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no file is put together with another
    try:
        changes = queries()["X5_expiry_timers"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "expiry" / "landed").glob("*.parquet"))) > 5
    commits = [f for f in (tmp_path / "expiry" / "log" / "commits").iterdir() if f.name.isdigit()]
    assert len(commits) <= 10  # a batch for each of the five runs, and one for the timers behind it
    assert changes.count() == changes.distinct().count() > 0


def test_buckets_of_listings_change_as_each_listing_would_alone():
    """Against the definition, one listing and one confirmation at a time, several of them in a batch."""
    import pandas as pd

    hour, rng = 60 * 60 * 1000, random.Random(5)

    class Held:
        def __init__(self):
            self.value, self.timers = None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    def due(one, now, said):
        while one["status"] != "DELETED":
            ahead = [(one["posted"] + 720 * hour, "DELETED")]
            if one["status"] == "ACTIVE" and one["source"] != "MANUAL":
                ahead.append((one["verified"] + 168 * hour, "EXPIRED"))
            at, status = min(ahead)
            if at >= now:
                return
            one["status"] = status
            said.append((one["id"], status, at))

    def batch(table, rows, now, said):
        for name in sorted({r[0] for r in rows}):
            mine = sorted((verified, posted, source) for i, source, posted, verified in rows if i == name)
            one = table.setdefault(name, {"id": name, "verified": mine[0][0], "posted": mine[0][1], "source": mine[0][2], "status": "ACTIVE"})
            due(one, now, said)
            for verified, *_ in mine:
                if one["status"] != "DELETED" and verified > one["verified"]:
                    one["verified"] = verified
                    if one["status"] == "EXPIRED":
                        one["status"] = "ACTIVE"
                        said.append((name, "ACTIVE", verified))
                    due(one, now, said)
        for one in table.values():
            due(one, now, said)
        for name in [n for n, one in table.items() if one["status"] == "DELETED"]:
            del table[name]

    held, table, kinds = Held(), {}, set()
    timers = expiry.ExpiryTimers()
    timers.init(held)
    for step in range(60):
        now = step * 20 * hour
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, at=now: at})()
        rows = [(f"job{rng.randrange(30)}", rng.choice(["LEVER", "MANUAL"]), hour * rng.randrange(-300, 900), now + hour * rng.randrange(-400, 100)) for _ in range(rng.choice([0, 1, 40]))]
        want, got = [], []
        batch(table, rows, now, want)
        if rows:
            parts = [pd.DataFrame(part, columns=["id", "source", "posted", "verified"]) for part in (rows[::2], rows[1::2]) if part]
            got += timers.handleInputRows((0,), iter(parts), clock)
        for at in [at for at in held.timers if at <= now]:
            got += timers.handleExpiredTimer((0,), clock, None)
            held.timers.remove(at)
        assert len(held.timers) == bool(table)
        assert sorted(r for part in got for r in part.itertuples(index=False, name=None)) == sorted(want)
        kinds |= {status for _, status, _ in want}
    assert kinds == {"EXPIRED", "ACTIVE", "DELETED"}


def test_timers_keep_a_state_for_a_bucket_not_for_a_listing(spark, tmp_path):
    rows = spark.range(6 * expiry.BUCKETS).selectExpr("CONCAT('job', id) AS id", "'LEVER' AS source", "TIMESTAMP '2024-01-01' AS posted_at", "TIMESTAMP '2024-01-02' AS verified_at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    changes = expiry.expiry_changes(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    run = expiry.write_changes(changes, f"{tmp_path}/out", f"{tmp_path}/log")
    run.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress)
    assert 0 < held <= 4 * expiry.BUCKETS  # the value, the timer and its index


def test_a_streamed_sync_does_not_read_all_listings_again_to_know_its_runs(spark, tmp_path, monkeypatch):
    from rolecall.catalog import queries
    from rolecall.catalog import streams as registered

    asked = []

    def stream_sync(arriving, runs, *_):
        asked.extend(runs.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(registered, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(streams, "stream_sync", stream_sync)
    try:
        queries()["X4_stream_sync"](spark, "/root/testdata/sf0.001")
    except InterruptedError:
        pass
    assert asked and not any("lineitem" in file for file in asked)
