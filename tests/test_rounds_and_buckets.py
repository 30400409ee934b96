"""Lineage in doubling rounds; upserts that write only the buckets they touch."""

import os
import random

from pyspark.sql import functions as F

from lakeweave.operators import lineage as lin
from lakeweave.streaming import streams as st


def depths(edges, start):
    out, frontier, d = {}, set(start), 0
    seen = set(start)
    while frontier:
        d += 1
        frontier = {c for c, p in edges if p in frontier and c is not None} - seen
        seen |= frontier
        out |= {n: d for n in frontier}
    return out


def test_a_chain_of_1000_takes_ten_rounds(spark, monkeypatch):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(1000)]
    written = []
    keep = lin.materialize
    monkeypatch.setattr(lin, "materialize", lambda df, label: written.append(label) or keep(df, label))
    e = spark.createDataFrame(edges, "child string, parent string")
    got = {r.node: r.depth for r in lin.lineage_doubling(e, spark.createDataFrame([("n0",)], "node string"), "downstream").collect()}
    assert got == {f"n{i}": i for i in range(1, 1001)}
    assert written.count("reached") - 1 <= 12


def test_doubling_equals_levels_on_graphs_with_cycles(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(150)] + [(f"m{i + 1}", f"m{i}") for i in range(40)]
    edges += [("n5", "m30"), ("m0", "n5"), ("n1", "n1"), (None, "n2"), ("n3", None)]
    e = spark.createDataFrame(edges, "child string, parent string")
    for start in (["n1", "n2"], ["m0"], ["nowhere"]):
        s = spark.createDataFrame([(x,) for x in start], "node string")
        got = {r.node: r.depth for r in lin.lineage_doubling(e, s, "downstream").collect()}
        assert got == depths(edges, start)


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "mart")
    schema = "k int, n int, v string"
    fn = st.upsert_buckets(path, ["k"], ["n"], 64)
    fn(spark.createDataFrame([(i, 0, "a") for i in range(1000)] + [(None, 0, "null")], schema), 0)
    one = spark.createDataFrame([(7, 1, "b"), (7, 2, "c")], schema)
    bucket = one.select(st.bucket_of(["k"], 64)).first()[0]
    fn(one, 1)
    assert [x for x in os.listdir(f"{path}/data/v=1") if x.startswith("_bucket")] == [f"_bucket={bucket}"]
    read = lambda **b: {(r.k, r.n, r.v) for r in st.read_buckets(spark, path, one.schema, **b).collect()}
    want = {(i, 0, "a") for i in range(1000)} - {(7, 0, "a")} | {(7, 2, "c"), (None, 0, "null")}
    assert read() == want
    fn(one, 1)  # a replay
    assert read() == want and (7, 0, "a") in read(before=1)
    fn(spark.createDataFrame([(7, 3, "d"), (5000, 0, "e")], schema), 2)
    assert read() == want - {(7, 2, "c")} | {(7, 3, "d"), (5000, 0, "e")}
    assert not os.path.exists(f"{path}/data/v=0/_bucket={bucket}")  # no state names it any more
    fn(spark.createDataFrame([], schema), 3)
    assert read() == want - {(7, 2, "c")} | {(7, 3, "d"), (5000, 0, "e")}
