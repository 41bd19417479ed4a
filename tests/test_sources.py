"""Readers on landed files, imports, snapshots and streams."""

import json

from pyspark.sql import functions as F

from rolecall.plans import activity
from rolecall.plans.views import Tables
from rolecall.sources import exports, feeds, tables
from rolecall.streaming import streams


def test_read_greenhouse_files(spark, tmp_path):
    job = {
        "id": 7, "title": " Data Engineer ", "absolute_url": "https://x/1", "updated_at": "2024-01-05T10:00:00-05:00",
        "location": {"name": "Pune"}, "offices": [{"name": "HQ", "location": None}], "departments": [{"name": "Eng"}],
        "content": "&lt;p&gt;Tea &amp;amp; bikes&lt;/p&gt;", "internal_job_id": 99,
    }
    undated = {"id": 8, "title": "x", "absolute_url": "https://x/2", "updated_at": "soon"}
    line = {"company_id": "c1", "token": "acme", "fetched_at": "2024-01-31T00:00:00Z", "payload": {"jobs": [job, undated]}}
    (tmp_path / "page.json").write_text(json.dumps(line))
    rows = feeds.read_greenhouse(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["external_id"], r["title"], r["locations"], r["department"]) == ("7", "Data Engineer", ["Pune", "HQ"], "Eng")
    assert (r["description"], r["requisition_id"]) == ("Tea & bikes", "99")
    assert r["posted_at"].isoformat() == "2024-01-05T15:00:00"


def test_ages_and_dates(spark):
    ages = ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "whenever", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, t string")
    assert [r[0] for r in df.select("i", feeds.workday_age_days(F.col("t")).alias("a")).orderBy("i").select("a").collect()] == [
        0, 1, 3, None, None, None,
    ]
    dates = ["2024-01-05", "January 5, 2024", "Jan 5, 2024", "2024-01-05T00:00:00.000Z", "Fri, 5 Jan 2024 00:00:00 GMT", "soon"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, t string")
    got = [r["d"] for r in df.select("i", feeds.parse_feed_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert [d.isoformat() if d else None for d in got] == ["2024-01-05T00:00:00"] * 5 + [None]


SHEET = (
    "﻿Company_Slug, Title ,description,discipline,level,tags,location,remote,salary_min,salary_max,apply_url\r\n"
    'acme,"Data, Engineer","Line one\nsaid ""hello"" to all of us",data,mid,SQL;Kafka,Pune,onsite,900000,1200000,https://x.in/1\r\n'
    ",,,,,,,,,,\r\n"
    'acme,Second one,"A long enough description",design,senior,,Pune,hybrid,,,https://x.in/2\r\n'
)


def test_csv_import(spark, tmp_path):
    companies = spark.createDataFrame([(1, "acme", "Acme")], "id long, slug string, name string")
    (tmp_path / "good.csv").write_text(SHEET, encoding="utf-8")
    records = exports.read_import(spark, str(tmp_path / "good.csv"))
    result = exports.import_jobs(records, companies)
    assert result.errors.count() == 0
    rows = {r["row_number"]: r for r in result.rows.collect()}
    assert rows[2]["title"] == "Data, Engineer"
    assert rows[2]["description"] == 'Line one\nsaid "hello" to all of us'
    assert (rows[2]["tags"], rows[2]["salary_disclosed"], rows[3]["currency"]) == (["SQL", "Kafka"], True, None)

    (tmp_path / "bad.csv").write_text(SHEET.replace("Second one", "x").replace("acme,Sec", "none,Sec"), encoding="utf-8")
    result = exports.import_jobs(exports.read_import(spark, str(tmp_path / "bad.csv")), companies)
    assert result.rows.count() == 0
    assert [(r["row_number"], r["errors"]) for r in result.errors.collect()] == [(3, ["title: too short"])]


def test_resume_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello there")
    (tmp_path / 'c "q".pdf').write_bytes(b"%PDF-")
    rows = {r["filename"]: r["reason"] for r in exports.read_resume_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.pdf": None, "b.pdf": "not_a_pdf", "c q.pdf": None}


def test_publish_and_read_back(spark, tmp_path):
    df = spark.range(100).withColumn("day", F.col("id") % 3)
    tables.publish(df, str(tmp_path / "t"), ["day"], ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).filter("day = 1").count() == 33


def test_application_stream_replay(spark):
    """A batch applied twice leaves the table as applied once, and late events move nothing back."""
    schema = "user_id long, job_id string, created_at timestamp, last_clicked_at timestamp, stage string"
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    stored = spark.createDataFrame([(1, "a", day(3), day(9), "OFFER")], schema)
    clicks = spark.createDataFrame([(1, "a", day(5)), (2, "b", day(6)), (2, "b", day(4))], "user_id long, job_id string, created_at timestamp")
    once = streams.upsert_applications(stored, clicks)
    twice = streams.upsert_applications(once, clicks)
    want = {(1, "a", day(3), day(9), "OFFER"), (2, "b", day(4), day(6), "APPLIED")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_shared_tables_carry_no_user_column(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    clicks = streams.anonymous_clicks(
        t.v_click.select("*", F.lit(None).cast("string").alias("referrer"), F.lit(None).cast("string").alias("country_code")), t.v_job
    )
    for shared in (t.v_job, t.v_company, clicks):
        assert not {c for c in shared.columns if "user" in c or "email" in c or "phone" in c}


def test_claims_of_new_company_names(spark):
    new = spark.createDataFrame([("Acme Ltd", "2024-01-01"), ("Acme  Ltd!", "2024-01-02"), ("***", "2024-01-02")], "name string, created_at string")
    new = new.withColumn("created_at", F.col("created_at").cast("timestamp"))
    stored = spark.createDataFrame([("acme-ltd",), ("acme",)], "slug string")
    assert {r["slug"] for r in activity.company_slugs(stored, new).collect()} == {"acme-ltd-2", "acme-ltd-3", "company"}


def test_large_sheets_are_imported_whole(spark):
    companies = spark.createDataFrame([(1, "acme", "Acme")], "id long, slug string, name string")
    cells = "'acme' company_slug, 'Data Engineer' title, 'A long enough description' description, 'data' discipline, 'mid' level, "
    cells += "'' tags, 'Pune' location, 'onsite' remote, 'https://x.in/1' apply_url, cast(id as int) row_number"
    result = exports.import_jobs(spark.range(1200).selectExpr(*cells.split(", ")), companies)
    assert (result.rows.count(), result.errors.count()) == (1200, 0)


def test_sitemap_files_hold_every_url(spark):
    rows = spark.range(1000).selectExpr("'job' section", "concat('u', id) url")
    files = exports.sitemap_files(rows, per_file=300)
    assert files.count() == 1000 and files.select("file").distinct().count() == 4
