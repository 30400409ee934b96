"""Merkle roots, seals, heads kept apart, proofs, and the chain of a stream."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import audit as aud
from lakeweave.operators import trail
from lakeweave.session import materialize
from lakeweave.sources import tables as src
from lakeweave.streaming import streams as st


@pytest.fixture(scope="module")
def normalized(spark, small_dir):
    return aud.normalize_events(src.audit_queries(spark, small_dir), aud.registry_frame(spark))


@pytest.fixture(scope="module")
def chained(normalized):
    return materialize(aud.chain_events(normalized), "trail")


def split_root(leaves):
    """The tree hash by its definition: split at the largest power of two below the number of leaves."""
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(f"1|{split_root(leaves[:k])}|{split_root(leaves[k:])}".encode()).hexdigest()


def test_stream_of_leaves_gives_the_tree_hash_and_all_paths():
    for n in [*range(1, 20), 64, 100]:
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        tree, paths = trail.Merkle(), [[] for _ in leaves]
        for leaf, path in zip(leaves, paths):
            tree.add(leaf, path)
        root = tree.root()
        assert root == split_root(leaves)
        for h, path in zip(leaves, paths):
            for left, other in path:
                h = hashlib.sha256((f"1|{other}|{h}" if left else f"1|{h}|{other}").encode()).hexdigest()
            assert h == root and len(path) <= max(1, n).bit_length()


def rehashed(chained, where, spark):
    """The segment ``where`` with other user names, linked anew from its own first link."""
    rows = chained.filter(where)
    plain = F.regexp_replace(F.regexp_replace("doc", '"previous_hash":"[^"]*"', f'"previous_hash":"{trail.PREV_PLACEHOLDER}"'),
                             '"username":"[^"]*"', '"username":"mallory"')
    start = rows.groupBy("source_system").agg(F.min_by("previous_hash", F.struct("ts", "event_id")).alias("head"))
    again = trail.chain_templates(rows.select("source_system", "seg_hour", "ts", "event_id", "query_id", plain.alias("template")), start)
    return chained.filter(~where).unionByName(again)


def in_order(chained, source):
    return [r.seg_hour for r in chained.filter(F.col("source_system") == source).select("seg_hour").distinct().orderBy("seg_hour").collect()]


def test_attacks_on_whole_segments_are_reported(spark, chained):
    seals, heads = materialize(aud.seal_segments(chained), "seals"), materialize(aud.chain_heads(chained), "heads")
    assert aud.verify_seals(chained, seals).count() == 0 and aud.verify_heads(chained, heads).count() == 0
    hours = in_order(chained, "trino")
    at = lambda k: (F.col("source_system") == "trino") & (F.col("seg_hour") == F.lit(hours[k]))
    for k, name in ((0, "first"), (len(hours) // 2, "middle"), (-1, "last")):
        cut = chained.filter(~at(k))
        assert [(r.seg_hour, r.problem) for r in aud.verify_seals(cut, seals).collect()] == [(hours[k], "missing segment")], name
        broken = [r.seg_hour for r in aud.broken_links(aud.verify_chain(cut)).collect()]
        assert broken == ([hours[k + 1]] if k >= 0 else [])  # a cut tail has no next link ...
        assert [r.problem for r in aud.verify_heads(cut, heads).collect()] == (["end differs"] if k == -1 else [])  # ... but its head is kept apart
    for k in (2, -1):
        forged = materialize(rehashed(chained, at(k), spark), "forged")
        assert forged.count() == chained.count()
        assert [(r.seg_hour, r.problem) for r in aud.verify_seals(forged, seals).collect()] == [(hours[k], "contents differ")]
        assert aud.broken_links(aud.verify_chain(forged)).count() + aud.verify_heads(forged, heads).count() == 1
    none = aud.verify_heads(chained.filter("source_system <> 'trino'"), heads).collect()
    assert [(r.source_system, r.problem) for r in none] == [("trino", "missing source")]
    added = chained.unionByName(chained.filter(at(3)).limit(1).withColumn("event_id", F.lit("zzz")))
    assert "events added or removed" in {r.problem for r in aud.verify_seals(added, seals).collect()}


def test_proofs_hold_only_for_what_was_stored(spark, chained):
    some = chained.orderBy("event_id").limit(25)
    p = aud.inclusion_proofs(chained, some).withColumn("holds", aud.proof_holds(F.col("leaf"), F.col("path"), F.col("root"))).collect()
    roots = {(r.source_system, r.seg_hour): r.root for r in aud.seal_segments(chained).collect()}
    assert len(p) == 25 and all(r.holds and roots[r.source_system, r.seg_hour] == r.root for r in p)
    wrong = aud.inclusion_proofs(chained, some).filter(F.size("path") > 0)
    assert wrong.filter(aud.proof_holds(F.sha2("leaf", 256), F.col("path"), F.col("root"))).count() == 0


def test_untimed_events_are_dealt_over_segments(spark, normalized):
    lost = normalized.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    c = materialize(aud.chain_events(lost), "untimed")
    assert c.count() == normalized.count() and c.select("seg_hour").distinct().count() > 100
    assert aud.broken_links(aud.verify_chain(c)).count() == 0


def test_smaller_segments_verify(normalized):
    c = materialize(aud.chain_events(normalized, segment_seconds=600), "short")
    assert aud.broken_links(aud.verify_chain(c)).count() == 0 and c.filter("minute(seg_hour) > 0").count() > 0


def test_stream_chain_is_the_batch_chain_and_keeps_late_events(spark, small_dir):
    ev = src.read_table(spark, small_dir, "events")
    cut = [dt.datetime(2024, 1, 8, 10, 17), dt.datetime(2024, 1, 20, 5, 40)]
    late = F.col("ts") < dt.datetime(2024, 1, 2)
    parts = [ev.filter((F.col("ts") < cut[0]) & ~late), ev.filter(F.col("ts").between(cut[0], cut[1]) & ~late), ev.filter((F.col("ts") > cut[1]) | late)]
    assert sum(p.count() for p in parts) == ev.count()
    out = st.stream_dir(spark, "chain")
    st.run_deliveries(spark, parts, lambda s: st.whole_segments(
        aud.normalize_events(src.audit_queries(spark, small_dir, s), aud.registry_frame(spark))).writeStream.foreachBatch(st.chain_batch(out)), "chain-in")
    got = spark.read.parquet(f"{out}/chain").drop("batch")
    on_time = got.filter(~F.col("source_system").endswith(trail.LATE))
    assert got.count() - on_time.count() == ev.filter(late).count() > 0
    assert aud.broken_links(aud.verify_chain(got)).count() == 0
    assert aud.verify_seals(got, spark.read.parquet(f"{out}/seals").drop("batch")).count() == 0
    assert aud.verify_heads(got, spark.read.parquet(st.latest_version(spark, f"{out}/heads"))).count() == 0
    norm = aud.normalize_events(src.audit_queries(spark, small_dir, ev.filter(~late)), aud.registry_frame(spark))
    end = on_time.agg(F.max("seg_hour")).first()[0]
    want = aud.chain_events(norm).filter(F.col("seg_hour") <= F.lit(end))
    rows = lambda df: sorted((r.event_id, r.previous_hash, r.this_hash) for r in df.collect())
    assert rows(on_time) == rows(want) and on_time.count() > 900


def test_keys_are_known_over_restarts_until_their_time_is_over(spark):
    def day(n):
        return spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=n, minutes=m), 1.5, None) for m, k in enumerate([1, 2, 2, None, None])],
                                     "k int, ts timestamp_ntz, v double, n decimal(9,2)")
    seen = {}

    def keep(batch, batch_id):
        rows = [(r.k, r._repeat, r.ts, r.v, r.n) for r in batch.collect()]
        if rows:
            seen[len(seen)] = rows
    st.run_deliveries(spark, [day(0), day(2), day(30), day(31)], lambda s: st.mark_repeats(s, ["k"], "ts").writeStream.foreachBatch(keep), "keys")
    flags = [sorted(((r[0], r[1]) for r in rows), key=str) for rows in seen.values()]
    fresh = [(1, False), (2, False), (2, True), (None, False), (None, False)]
    known = [(1, True), (2, True), (2, True), (None, False), (None, False)]
    assert flags == [fresh, known, known, fresh]  # on day 31 the watermark of day 30 has ended the keys of day 0
    assert all(r[2].microsecond == 0 and r[3] == 1.5 and r[4] is None for rows in seen.values() for r in rows)


def test_late_rows_are_kept_aside_by_key(spark):
    t = dt.datetime(2024, 1, 10)
    rows = [[("a", t), ("b", t - dt.timedelta(days=30)), ("a", None)], [("a", t - dt.timedelta(days=8)), ("b", t - dt.timedelta(days=31)), ("c", t)],
            [("a", t - dt.timedelta(days=6)), ("c", t - dt.timedelta(days=9))]]
    out = st.stream_dir(spark, "late")
    st.run_deliveries(spark, [spark.createDataFrame(r, "k string, ts timestamp_ntz") for r in rows],
                      lambda s: s.writeStream.foreachBatch(st.late_batch(out, "ts", "168 hours", ["k"])), "late-in")
    got = spark.read.parquet(f"{out}/rows")
    late = {(r.k, r.ts) for r in got.filter("CAST(late AS boolean)").collect()}
    assert got.count() == 8 and late == {("a", t - dt.timedelta(days=8)), ("c", t - dt.timedelta(days=9))}
