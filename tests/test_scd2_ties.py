import datetime as dt

from lakeweave.operators import tables as tbl


def test_equal_times_have_one_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "x"), ("a", t, "y"), ("a", t + dt.timedelta(days=1), "y"), ("a", t + dt.timedelta(days=70), "x"), ("b", t, "z"), ("b", t, "z")]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, s string")
    want = [("a", t, "x", t, t, False), ("a", t, "y", t, t + dt.timedelta(days=70), False), ("a", t + dt.timedelta(days=70), "x", t + dt.timedelta(days=70), None, True),
            ("b", t, "z", t, None, True)]
    for days in (30, None):
        for n in (1, 5):
            out = tbl.scd2(df.repartition(n), ["k"], "at", ["s"], days).select("k", "at", "s", "valid_from", "valid_to", "is_current")
            assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
