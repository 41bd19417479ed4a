"""Every registered query against its oracle text on the smallest data set."""

import datetime
import decimal

import duckdb
import pytest

from rolecall import catalog
from rolecall.plans.views import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    got = table(df.columns, df.collect())
    if key in ORACLES:
        want = duck.sql(ORACLES[key])
        assert got == table(want.columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_greenhouse_payload_is_not_read_back_before_it_lands(spark, monkeypatch):
    from rolecall.catalog import feeds as rendered

    plans = []

    def landed(rows, payload, schema):
        plans.append(rows.select(payload)._jdf.queryExecution().analyzed().toString())
        raise LookupError

    monkeypatch.setattr(rendered, "_landed", landed)
    with pytest.raises(LookupError):
        catalog.queries()["S1_feed_greenhouse"](spark, "/root/testdata/sf0.001")
    assert "from_json" not in plans[0]
