"""How often the trail's operators deal rows by segment."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import trail
from lakeweave.session import materialize


@pytest.fixture(scope="module")
def rows(spark):
    t = dt.datetime(2024, 1, 1)
    return materialize(spark.createDataFrame([(s, t + dt.timedelta(hours=h), t + dt.timedelta(hours=h, minutes=i), f"{s}{h}{i}", f"q{i}", f'{{"previous_hash":"{trail.PREV_PLACEHOLDER}","x":{i}}}')
                                              for s in "ab" for h in range(3) for i in range(5)],
                                             "source_system string, seg_hour timestamp_ntz, ts timestamp_ntz, event_id string, query_id string, template string"), "rows")


def plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as a whole
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_chain_deals_its_rows_once(spark, rows):
    assert "ReusedExchange" in plan(spark, trail.chain_templates(rows))


def test_heads_take_the_last_segments_only(spark, rows):
    chained = materialize(trail.chain_templates(rows), "trail")
    heads = trail.chain_heads(chained)
    assert "LeftSemi" in plan(spark, heads)
    assert sorted(heads.collect()) == sorted(trail.last_heads(trail.seal_segments(chained)).collect())
    lost = chained.withColumn("seg_hour", F.lit(None).cast("timestamp_ntz")).withColumn("source_system", F.lit(None).cast("string"))
    assert sorted(trail.chain_heads(lost).collect()) == sorted(trail.last_heads(trail.seal_segments(lost)).collect())


def test_seals_and_verification_share_an_exchange(spark, rows):
    chained = materialize(trail.chain_templates(rows), "trail")
    seals = trail.verify_seals(chained, materialize(trail.seal_segments(chained), "seals")).select("seg_hour")
    assert "ReusedExchange" in plan(spark, seals.unionByName(trail.broken_links(trail.verify_chain(chained)).select("seg_hour")))


def test_proofs_deal_the_trail_once(spark, rows):
    chained = materialize(trail.chain_templates(rows), "trail")
    proofs = trail.inclusion_proofs(chained, chained.filter("query_id = 'q3'"))
    assert plan(spark, proofs).count("Exchange hashpartitioning") == 1 and proofs.count() == 6
