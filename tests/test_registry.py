"""Every registered query against its DuckDB oracle on the smallest fixtures
(the driver runs the same comparison at sf0.01), plus the smoke entry."""

import duckdb
import pytest

import __spark_entry__ as E
from lakeweave.plans.registry import ORACLES, QUERIES
from lakeweave.sources.tables import TABLES
from tools.oracle_check import digest

NAMES = sorted(QUERIES)  # the optional training-data queries have their own tests


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_revenue_usd" in df.columns


def test_every_query_has_an_oracle_or_is_listed():
    rows_only = {"g18_subject_report"}
    assert set(QUERIES) - set(ORACLES) == rows_only


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_dir, name):
    df = E.queries()[name](spark, small_dir)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(cols) > 0
        return
    res = con.sql(sql)
    ocols, orows = res.columns, res.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows) == digest(ocols, orows)


TIME_SENSITIVE = ["a4_tpch_q6", "p8_since_7_days", "q14_source_freshness", "m6_success_ratios",
                  "m13_silent_sources", "s5_ingest_documents", "x2_stream_rate_5m", "t4_as_of_timestamp"]


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_results_do_not_depend_on_session_time_zone(spark, con, small_dir, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = E.queries()[name](spark, small_dir)
        cols, rows = df.columns, [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    res = con.sql(E.oracle_sql()[name])
    assert digest(cols, rows) == digest(res.columns, res.fetchall())
