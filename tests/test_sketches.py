"""Sketches merged over days against one pass and against exact results."""

import datetime as dt

from pyspark.sql import functions as F

from lakeweave.operators import sketches as sk


def test_merged_days_are_the_span(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 3).alias("g"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 31).cast("int")).alias("day_of"),
        F.when(F.col("id") % 11 != 0, F.pow(F.col("id") % 5000, F.lit(2)).cast("double")).alias("v"), (F.col("id") % 7000).cast("string").alias("u"))
    days = sk.daily(df, ["g"], F.col("day_of"), ["u"], ["v"])
    assert days.count() == 93
    for keys in (["g"], []):
        m = sk.merged(days, keys)
        one = sk.merged(sk.daily(df, keys, F.lit(dt.date(2024, 1, 1)), ["u"], ["v"]), keys)
        cols = [*keys, "rows", "n_v", "sum_v", "low_v", "high_v", "min_u", "max_u", "n_u"]
        assert sorted(m.select(*cols).collect()) == sorted(one.select(*cols).collect())
        assert sorted(m.select(*keys, sk.distinct_count("u")).collect()) == sorted(one.select(*keys, sk.distinct_count("u")).collect())
        for q in (0.01, 0.5, 0.95):
            e = sk.rank_error(df, m.withColumn("q", sk.quantile("v", q)), keys, "v", {"q": q}).collect()
            assert all(r.q <= 0.0165 for r in e)
    again = sk.merged(sk.merged(days, ["g"]))
    exact = df.select("u").distinct().count()
    assert abs(again.select(sk.distinct_count("u")).first()[0] - exact) <= 0.065 * exact


def test_bottom_sample_of_samples_and_empty_groups(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).alias("day"), "id")
    by_day = sk.bottom_sample(df, ["g", "day"], ["id"], 30)
    whole = sk.bottom_sample(df, ["g"], ["id"], 30)
    assert sorted(r.id for r in sk.bottom_sample(by_day, ["g"], ["id"], 30).collect()) == sorted(r.id for r in whole.collect())
    none = spark.createDataFrame([(1, None, None)], "g int, v double, u string")
    row = sk.merged(sk.daily(none, ["g"], F.lit(dt.date(2024, 1, 1)), ["u"], ["v"]), ["g"])
    r = row.select("rows", "n_v", sk.quantile("v", 0.5).alias("q"), sk.distinct_count("u").alias("d")).first()
    assert tuple(r) == (1, 0, None, 0)
    assert sk.merged(sk.daily(none.limit(0), ["g"], F.lit(dt.date(2024, 1, 1)), ["u"], ["v"]), ["g"]).count() == 0
