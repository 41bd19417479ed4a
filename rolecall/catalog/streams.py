"""Registered queries: the streaming jobs, run over the event files until they are used up (X operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolecall.catalog import query
from rolecall.catalog.ingest import as_of
from rolecall.plans.views import AS_OF
from rolecall.session import scratch_path
from rolecall.streaming import expiry, streams

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(t, kind=None):
    events = streams.read_events(t.spark, t.sf_dir, _SCHEMA, "events.parquet")
    events = events.filter(F.col("event_type") == kind) if kind else events
    number = F.get_json_object("props", "$.k")
    return events.withColumn("job_id", F.concat(F.lit("job"), F.lpad(number, 12, "0"))).withColumn("created_at", F.col("ts"))


def _run(t, df, name):
    path = scratch_path(t.spark, name)
    streams.write_stream(df, f"{path}/out", f"{path}/log").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query(
    "X1_stream_clicks",
    """SELECT c.job_id, CASE WHEN c.event_id % 3 <> 0 THEN concat('news.example.com:8080/p/', CAST(c.user_id AS VARCHAR)) END AS referrer,
 CASE WHEN c.event_id % 2 = 0 THEN 'IN' END AS country_code, c.created_at FROM v_click c JOIN v_job j ON j.id = c.job_id WHERE j.status = 'ACTIVE'""",
)
def clicks(t):
    k = F.col("event_id")
    url = F.concat(F.lit("https://me:pw@News.example.com:8080/p/"), "user_id", F.lit("?q=secret#top"))
    requests = _events(t, "click").select(
        "job_id",
        F.when(k % 3 == 0, "not a url").otherwise(url).alias("referrer"),
        F.when(k % 2 == 0, "IN").otherwise("India").alias("country_code"),
        "created_at",
    )
    return _run(t, streams.anonymous_clicks(requests, t.v_job), "clicks")


@query(
    "X2_stream_applications",
    """WITH c AS (SELECT user_id, job_id, min(created_at) AS first_at, max(created_at) AS last_at FROM v_click GROUP BY 1, 2)
 SELECT coalesce(a.user_id, c.user_id) AS user_id, coalesce(a.job_id, c.job_id) AS job_id,
  least(coalesce(a.created_at, c.first_at), coalesce(c.first_at, a.created_at)) AS created_at,
  greatest(coalesce(a.last_clicked_at, c.last_at), coalesce(c.last_at, a.last_clicked_at)) AS last_clicked_at, coalesce(a.stage, 'APPLIED') AS stage
 FROM v_application a FULL OUTER JOIN c ON a.user_id = c.user_id AND a.job_id = c.job_id""",
)
def applications(t):
    path = scratch_path(t.spark, "applications")
    stored = t.v_application.select(
        "user_id", "job_id", F.col("created_at").cast("timestamp"), F.col("last_clicked_at").cast("timestamp"), "stage"
    )
    clicks = _events(t, "click").select("user_id", "job_id", "created_at")
    table = streams.applications_table(stored, f"{path}/table")
    run = streams.stream_applications(clicks, table, f"{path}/log")
    run.awaitTermination()
    return streams.latest_version(table, run)


@query(
    "X3_click_windows",
    """SELECT date_trunc('day', created_at) AS day, job_id, count(*) AS clicks FROM v_click GROUP BY 1, 2
 HAVING date_trunc('day', created_at) + INTERVAL '1' DAY <= (SELECT max(created_at) - INTERVAL '1' DAY FROM v_click)""",
)
def days(t):
    return _run(t, streams.daily_clicks(_events(t, "click").select("job_id", "created_at")), "days").withColumn(
        "day", F.col("day").cast("timestamp")
    )


@query(
    "X3_recent_clicks",
    f"""SELECT job_id, count(*) FILTER (WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) AS clicks_7d, count(*) AS clicks_30d
 FROM v_click WHERE created_at < TIMESTAMP '{AS_OF}' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY GROUP BY job_id""",
)
def recent(t):
    """The same daily buckets on a table, summed over the last 7 and 30 days."""
    daily = streams.daily_clicks(t.v_click.select("job_id", F.col("created_at").cast("timestamp").alias("created_at")))
    return streams.recent_clicks(daily, as_of(), [7, 30])


# Five runs, four days apart. A role is confirmed by the first ones; some are met again after their week is over.
_CONFIRMED = """SELECT id, source, posted_at, TIMESTAMP '2024-01-15 00:00:00' + r * INTERVAL '4' DAY AS verified_at, r AS run
 FROM (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM v_job) j JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(r)) n
 ON r <= k % 5 OR (k % 10 = 0 AND r = 3)"""


@query(
    "X5_expiry_timers",
    f"""WITH c AS (SELECT *, posted_at + INTERVAL '30' DAY AS gone, verified_at + INTERVAL '7' DAY AS stale, lead(verified_at) OVER (PARTITION BY id ORDER BY verified_at) AS again
  FROM ({_CONFIRMED}) x WHERE posted_at >= verified_at - INTERVAL '30' DAY), w AS (SELECT max(verified_at) AS now FROM c)
 SELECT id, 'EXPIRED' AS status, stale AS at FROM c, w WHERE source <> 'MANUAL' AND stale < coalesce(again, now) AND stale < gone
 UNION ALL SELECT id, 'ACTIVE', again FROM c WHERE source <> 'MANUAL' AND again > stale
 UNION ALL SELECT DISTINCT id, 'DELETED', gone FROM c, w WHERE gone < now""",
)
def expiry_timers(t):
    """Confirmations land run by run; the timers of a listing fire when the watermark has passed them.

    The stream goes on from its checkpoint after each landing and takes all files of the run in one
    batch: a run is as many files as tasks wrote, and each batch of a file costs a pass over all state.
    """
    path = scratch_path(t.spark, "expiry")
    t.sql(_CONFIRMED).write.parquet(f"{path}/confirmed")
    confirmed = t.spark.read.parquet(f"{path}/confirmed")
    schema = "id string, source string, posted_at timestamp, verified_at timestamp"
    for run in range(5):
        confirmed.filter(F.col("run") == run).drop("run").write.mode("append").parquet(f"{path}/landed")
        changes = expiry.expiry_changes(t.spark.readStream.schema(schema).parquet(f"{path}/landed"))
        expiry.write_changes(changes, f"{path}/changes", f"{path}/log").awaitTermination()
    return t.spark.read.schema(changes.schema).parquet(f"{path}/changes")


@query(
    "X6_rate_flag",
    """SELECT start, user_id AS client, requests FROM (
 SELECT time_bucket(INTERVAL '1 day', ts) - i * INTERVAL '1 day' AS start, user_id, count(*) AS requests
 FROM events, range(0, 4) r(i) GROUP BY 1, 2) x WHERE requests > 2
 AND start + INTERVAL '4 day' <= (SELECT max(ts) - INTERVAL '4 day' FROM events)""",
)
def rates(t):
    requests = _events(t).select("ts", "user_id")
    return _run(t, streams.rate_flags(requests, "user_id", 2, "4 days", "1 day"), "rates")


@query(
    "X7_funnel",
    """WITH last AS (SELECT user_id, job_id, max_by(event_type, event_id) AS kind FROM (
  SELECT event_id, user_id, event_type, concat('job', lpad(replace(replace(props, '{"k": ', ''), '}', ''), 12, '0')) AS job_id FROM events
  WHERE event_type IN ('view', 'error')) e GROUP BY user_id, job_id)
 SELECT 'click' AS step, count(*) AS n FROM v_click UNION ALL SELECT 'application', count(*) FROM v_application
 UNION ALL SELECT CASE l.kind WHEN 'view' THEN 'INTERVIEWING' WHEN 'error' THEN 'REJECTED' ELSE a.stage END, count(*) FROM v_application a
 LEFT JOIN last l ON l.user_id = a.user_id AND l.job_id = a.job_id GROUP BY 1""",
)
def funnel(t):
    stage = F.when(F.col("event_type") == "view", "INTERVIEWING").otherwise("REJECTED")
    job = F.concat(F.lit("job"), F.lpad(F.get_json_object("props", "$.k"), 12, "0"))
    changes = t.events.filter(F.col("event_type").isin("view", "error")).select(
        "user_id", job.alias("job_id"), stage.alias("stage"), F.col("event_id").alias("stage_updated_at")
    )
    return streams.funnel(t.v_click, t.v_application, changes)


_STORED = """SELECT company_id, source, id AS external_id, title, status, CASE WHEN featured THEN 'older' ELSE status END AS content_hash,
 posted_at, last_verified_at FROM v_job WHERE source <> 'LEVER' AND company_id % 3 <> 0"""
# Two successive runs of one feed: the second lists fewer roles, some of them changed, and fails for some companies.
_LANDED = """SELECT 1 AS run_id, company_id, source, id AS external_id, title, salary_disclosed, posted_at, status AS content_hash,
 false AS list_only, true AS detail_ready FROM v_job WHERE source = 'GREENHOUSE'
 UNION ALL SELECT 2, company_id, source, id, CASE WHEN k % 7 = 0 THEN concat(title, ' (second)') ELSE title END, salary_disclosed, posted_at,
 CASE WHEN k % 7 = 0 THEN 'second' ELSE status END, false, true FROM (SELECT *, CAST(substr(id, 4) AS BIGINT) AS k FROM v_job) b
 WHERE source = 'GREENHOUSE' AND k % 4 <> 0 AND company_id % 5 <> 0"""
_RUNS = f"""SELECT c.run_id, c.company_id, 'GREENHOUSE' AS source, c.run_id = 1 OR c.company_id % 5 <> 0 AS ok,
 CASE WHEN c.run_id = 2 AND c.company_id % 5 = 0 THEN 'Fetch failed: timeout' END AS error, CAST(count(l.external_id) AS BIGINT) AS fetched,
 CASE WHEN c.run_id = 1 THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{AS_OF}' + INTERVAL '1' DAY END AS run_at
 FROM (SELECT DISTINCT r.run_id, company_id FROM v_job CROSS JOIN (SELECT 1 AS run_id UNION ALL SELECT 2) r WHERE source = 'GREENHOUSE') c
 LEFT JOIN ({_LANDED}) l ON l.run_id = c.run_id AND l.company_id = c.company_id GROUP BY c.run_id, c.company_id"""


@query(
    "X4_stream_sync",
    f"""WITH two AS (SELECT company_id, ok AND fetched > 0 AS read FROM ({_RUNS}) r WHERE run_id = 2),
 j AS (SELECT v.*, CAST(substr(v.id, 4) AS BIGINT) % 4 <> 0 AS again, CAST(substr(v.id, 4) AS BIGINT) % 7 = 0 AS changed, two.read
  FROM v_job v JOIN two ON two.company_id = v.company_id WHERE v.source = 'GREENHOUSE')
 SELECT external_id, title, status, last_verified_at FROM ({_STORED}) s WHERE source = 'MANUAL'
 UNION ALL SELECT id, CASE WHEN read AND again AND changed THEN concat(title, ' (second)') ELSE title END,
  CASE WHEN read AND NOT again THEN 'EXPIRED' ELSE 'ACTIVE' END,
  CASE WHEN read AND again THEN TIMESTAMP '{AS_OF}' + INTERVAL '1' DAY ELSE TIMESTAMP '{AS_OF}' END FROM j""",
)
def synced(t):
    """Listings land as files, each run in several, and are diffed feed by feed once a feed's run is whole."""
    path = scratch_path(t.spark, "sync")
    landed = t.sql(_LANDED)
    landed.repartition(3).write.parquet(f"{path}/landed")
    # Every batch asks several times which runs there are: a small table, made once from all listings.
    t.sql(_RUNS).write.parquet(f"{path}/runs")
    runs = t.spark.read.parquet(f"{path}/runs")
    stored = t.sql(_STORED)
    arriving = t.spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/landed")
    tables = streams.sync_tables(stored, arriving, f"{path}/tables")
    run = streams.stream_sync(arriving, runs, tables, f"{path}/log")
    run.awaitTermination()
    return streams.latest_version(tables.jobs, run).select("external_id", "title", "status", "last_verified_at")
