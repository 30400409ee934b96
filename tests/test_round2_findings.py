"""Silent losses and policy holes that were found by review: each has a case here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import audit as au
from lakeweave.operators import governance as gov
from lakeweave.operators import quality as qa
from lakeweave.operators import tables as tbl
from lakeweave.operators import telemetry as tm
from lakeweave.operators.lineage import lineage
from lakeweave.sources import documents as docs
from lakeweave.streaming import streams as st


def test_row_filter_binds_attributes_as_values(spark):
    df = spark.createDataFrame([("eu", 1), ("us", 2)], "region string, x int")
    filters = {"c.s.t": [(("analysts",), "region = current_setting('region', true)")]}
    for value, n in (("eu", 1), ("\\' OR true -- ", 0), ("' OR '1'='1", 0), (None, 0)):
        who = gov.Principal("u", ("analysts",), {} if value is None else {"region": value})
        assert gov.row_filter(df, "c.s.t", who, filters).count() == n


def test_two_tags_on_a_column_take_the_stricter_mask(spark):
    df = spark.createDataFrame([("123-45-6789",)], "ssn string")
    for order in ([("ssn", "PII_HIGH"), ("ssn", "PII_SSN")], [("ssn", "PII_SSN"), ("ssn", "PII_HIGH")]):
        tags = spark.createDataFrame(order, "column_name string, tag string")
        assert gov.mask_by_tags(df, tags, "data-analysts").first()[0] is None
    unknown = spark.createDataFrame([("ssn", "NO_POLICY")], "column_name string, tag string")
    assert gov.mask_by_tags(df, unknown, "data-engineers").first()[0] is None


def test_globs_have_one_meaning():
    rules = [("allow", "g", "iceberg", "cur?ted", "*", ("select",), None)]
    who = gov.Principal("u", ("g",))
    assert gov.decide(who, "iceberg", "curated", "t", "select", rules) == "DENY"
    assert gov.decide(who, "iceberg", "cur?ted", "t", "select", rules) == "ALLOW"


def test_null_merge_keys_are_inserts(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    updates = spark.createDataFrame([(None, "x"), (None, "y"), (1, "b")], "k int, v string")
    assert sorted(r["v"] for r in tbl.merge_upsert(target, updates, ["k"]).collect()) == ["b", "x", "y"]


def test_splits_lose_no_row(spark):
    rows = spark.createDataFrame([(1, None), (2, "call +1 555-123-4567"), (3, "plain")], "id int, text string")
    clean, found = qa.quarantine_pii(rows, "text")
    assert sorted(r["id"] for r in clean.collect()) == [1, 3] and [r["id"] for r in found.collect()] == [2]
    times = spark.createDataFrame([(1, None), (2, dt.datetime(2020, 1, 1))], "id int, ts timestamp_ntz")
    good, late = st.split_late(times, "ts", "2024-01-01 00:00:00")
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in late.collect()] == [2]
    layered = times.withColumn("layer", F.lit("raw"))
    kept = tbl.apply_retention(layered, "ts", "layer", tbl.retention_policy(spark), "2024-01-01 00:00:00")
    assert [r["id"] for r in kept.collect()] == [1]


def test_lineage_runs_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "child string, parent string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert lineage(edges, start).count() == 7
    with pytest.raises(ValueError):
        lineage(edges, start, max_depth=3)
    assert lineage(edges, start, max_depth=7).count() == 7


def test_long_texts_are_not_cut(spark):
    df = spark.createDataFrame([("x" * 70000,)], "extracted_text string")
    assert docs.prepare_raw_documents(df).select(F.length("extracted_text")).first()[0] == 70000


def test_only_scrapes_are_noise(spark):
    lines = spark.createDataFrame([("trino-worker", "GET /metrics/prometheus 200"), ("ranger-admin", "see /metrics-export"),
                                   ("trino", "query /metrics"), ("x", "  "), (None, "GET /metrics/prometheus")], "service string, body string")
    assert tm.drop_noise(lines).count() == 3


def test_json_logs_of_all_services_and_stamps(spark):
    stamps = ["2024-01-02T03:04:05.123456789Z", "2024-01-02T05:04:05.123456+02:00", "2024-01-02T03:04:05.123456", "yesterday"]
    lines = spark.createDataFrame([(i, s, '{"timestamp":"%s","level":"INFO"}' % t) for i, (s, t) in enumerate(
        zip(("trino-worker", "airflow-scheduler", "keycloak", "trino"), stamps))] + [(4, None, "x")], "id int, service string, body string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = sorted(tm.parse_logs(lines).select("id", "log_ts", "level").collect())
            assert [r.log_ts for r in rows] == [dt.datetime(2024, 1, 2, 3, 4, 5, 123456)] * 3 + [None] * 2
            assert [r.level for r in rows] == ["INFO"] * 4 + [None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_removed_links_are_broken(spark, small_dir):
    from lakeweave.plans.registry import chained_df

    chained = chained_df(spark, small_dir)
    assert au.broken_links(au.verify_chain(chained)).count() == 0
    cut = chained.withColumn("previous_hash", F.lit(None).cast("string"))
    assert au.broken_links(au.verify_chain(cut)).count() == chained.count()


def test_upsert_batches_take_the_last_version(spark, tmp_path):
    fn = st.upsert_batch(str(tmp_path), ["k"], ["n"])
    fn(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string"), 0)
    fn(spark.createDataFrame([(2, 5, "d"), (2, 4, "e")], "k int, n int, v string"), 1)
    out = spark.read.parquet(f"{tmp_path}/v=1")
    assert sorted(map(tuple, out.collect())) == [(1, 2, "b"), (2, 5, "d")]
