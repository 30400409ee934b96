import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeweave.functions.columns import safe_divide, surrogate_key, zpad
from lakeweave.operators import models as mdl
from lakeweave.operators import tables as tbl

RAW_ORDER_COLS = "order_id long, customer_id string, order_date string, status string, total_amount double, " \
                 "currency string, updated_at string, _ingested_at timestamp_ntz"
TS = dt.datetime(2024, 1, 1)


def test_stg_orders_keeps_raw_status_comparison(spark):
    # D1: 'Completed' normalises to 'completed' but is not completed
    raw = spark.createDataFrame([
        (1, "C1", "2024-01-01", "completed", 10.0, None, "2024-01-02 00:00:00", TS),
        (2, "C1", "2024-01-01", " Completed ", 5.0, " eur", "garbage", TS),
        (3, None, "2024-01-01", "completed", 5.0, "usd", None, TS),
        (4, "C2", None, "pending", 5.0, "usd", None, TS),
    ], RAW_ORDER_COLS)
    rows = {r.order_id: r for r in mdl.stg_orders(raw).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].is_completed is True and rows["1"].currency == "USD"
    assert rows["2"].status == "completed" and rows["2"].is_completed is False
    assert rows["2"].currency == "EUR" and rows["2"].updated_at is None


def test_safe_divide_and_surrogate_key(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_divide("n", "d")).collect()]
    assert got == [0.0, 0.0, None, 1.5]
    k = spark.createDataFrame([("a", None)], "a string, b string").select(surrogate_key(["a", "b"])).first()[0]
    import hashlib
    assert k == hashlib.md5(b"a|_null_").hexdigest()


def test_zpad_never_truncates(spark):
    df = spark.createDataFrame([(5,), (1234567,)], "k long")
    assert [r[0] for r in df.select(zpad(F.col("k"), 6)).collect()] == ["000005", "1234567"]


def _target(spark):
    return spark.createDataFrame([(1, "a", "EU"), (2, "b", "US"), (None, "n", "EU")], "id long, value string, region string")


def test_merge_upsert_updates_and_inserts(spark):
    upd = spark.createDataFrame([(2, "B", "US"), (3, "c", "EU"), (None, "m", "EU")], "id long, value string, region string")
    out = tbl.merge_upsert(_target(spark), upd, ["id"])
    rows = sorted((r.id or -1, r.value) for r in out.collect())
    # NULL keys never match: both NULL-key rows stay
    assert rows == [(-1, "m"), (-1, "n"), (1, "a"), (2, "B"), (3, "c")]


def test_merge_single_row_update_keeps_count(spark):
    upd = spark.createDataFrame([(1, "z", "EU")], "id long, value string, region string")
    out = tbl.merge_upsert(_target(spark), upd, ["id"])
    assert out.filter("id = 1").count() == 1 and out.filter("id = 1").first().value == "z"


def test_merge_is_idempotent(spark):
    upd = spark.createDataFrame([(2, "B", "US"), (4, "d", "EU")], "id long, value string, region string")
    once = tbl.merge_upsert(_target(spark), upd, ["id"])
    twice = tbl.merge_upsert(once, upd, ["id"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_merge_duplicate_source_keys_raise(spark):
    upd = spark.createDataFrame([(2, "x", "US"), (2, "y", "US")], "id long, value string, region string")
    with pytest.raises(Exception, match="duplicate keys"):
        tbl.merge_upsert(_target(spark), upd, ["id"]).collect()


def test_dedupe_latest_is_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "z"), (2, 1, "q")], "k long, t long, v string")
    out = sorted(tuple(r) for r in tbl.dedupe_latest(df, ["k"], ["t"]).collect())
    assert out == [(1, 5, "b"), (2, 1, "q")]


def _changes(spark):
    return spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 1), "I", "a"), (1, 2, dt.datetime(2024, 1, 2), "U", "b"),
        (2, 1, dt.datetime(2024, 1, 1), "I", "c"), (2, 3, dt.datetime(2024, 1, 3), "D", None),
    ], "id long, version long, committed_at timestamp_ntz, op string, v string")


def test_as_of_version_and_timestamp(spark):
    c = _changes(spark)
    assert sorted((r.id, r.v) for r in tbl.as_of(c, ["id"], version=1).collect()) == [(1, "a"), (2, "c")]
    assert sorted((r.id, r.v) for r in tbl.as_of(c, ["id"], version=3).collect()) == [(1, "b")]
    assert sorted((r.id, r.v) for r in tbl.as_of(c, ["id"], ts="2024-01-02 12:00:00").collect()) == [(1, "b"), (2, "c")]


def test_as_of_before_first_snapshot_raises(spark):
    with pytest.raises(Exception, match="before the first snapshot"):
        tbl.as_of(_changes(spark), ["id"], ts="2023-12-31 00:00:00").collect()


def test_scd2_collapses_unchanged_versions(spark):
    c = spark.createDataFrame([(1, dt.datetime(2024, 1, d), s) for d, s in [(1, "a"), (2, "a"), (3, "b"), (4, "b")]],
                              "id long, ts timestamp_ntz, s string")
    out = tbl.scd2(c, ["id"], "ts", ["s"]).orderBy("valid_from").collect()
    assert [(r.s, r.valid_from.day, r.valid_to.day if r.valid_to else None, r.is_current) for r in out] == \
        [("a", 1, 3, False), ("b", 3, None, True)]


def test_incremental_fct_equals_full_build(spark, small_dir):
    from lakeweave.plans import registry as R
    full = R.fct_df(spark, small_dir)
    inc = mdl.fct_orders(R.stg_orders_df(spark, small_dir), R.dim_df(spark, small_dir),
                         existing=R._fct_batch1(spark, small_dir))
    assert full.exceptAll(inc).count() == 0 and inc.exceptAll(full).count() == 0


def test_expirable_never_drops_last_five(spark):
    snaps = spark.createDataFrame([("t", i, dt.datetime(2024, 1, i)) for i in range(1, 9)],
                                  "table_name string, snapshot_id long, committed_at timestamp_ntz")
    out = tbl.expirable(snaps, "2024-03-01 00:00:00", 7, 5)
    assert sorted(r.snapshot_id for r in out.filter("expire").collect()) == [1, 2, 3]


def test_diff_versions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "Y"), (3, "z")], "id long, v string")
    got = sorted((r.id, r.change_type) for r in tbl.diff_versions(a, b, ["id"]).collect())
    assert got == [(1, "deleted"), (2, "updated"), (3, "inserted")]


def test_compaction_plan_groups(spark):
    files = spark.createDataFrame([(f"t/p/f{i:02d}", "p", 40, TS) for i in range(10)],
                                  "path string, partition string, size_bytes long, modified_at timestamp_ntz")
    plan = tbl.compaction_plan(files, min_files=10, target_bytes=100).collect()
    assert sorted({r.rewrite_group for r in plan}) == [0, 1, 2, 3]
    assert tbl.compaction_plan(files, min_files=11).count() == 0


def test_scd2_bucketed_equals_single_window(spark, small_dir):
    c = tbl.order_changes(spark.read.parquet(f"{small_dir}/orders.parquet")).filter(F.col("op") != "D")
    a = tbl.scd2(c, ["order_id"], "committed_at", ["status"], bucket_days=None)
    for days in (1, 30, 400):
        b = tbl.scd2(c, ["order_id"], "committed_at", ["status"], bucket_days=days).select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_scd2_across_buckets(spark):
    rows = [(1, dt.datetime(2024, 1, d), s) for d, s in [(1, "a"), (5, "a"), (12, "b"), (13, "b"), (30, "a")]]
    c = spark.createDataFrame(rows, "id long, ts timestamp_ntz, s string")
    out = tbl.scd2(c, ["id"], "ts", ["s"], bucket_days=3).orderBy("valid_from").collect()
    assert [(r.s, r.valid_from.day, r.valid_to.day if r.valid_to else None) for r in out] == \
        [("a", 1, 12), ("b", 12, 30), ("a", 30, None)]
