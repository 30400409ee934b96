import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import audit as aud
from lakeweave.operators import telemetry as tm
from lakeweave.sources import documents as docs
from lakeweave.sources import tables as src


@pytest.fixture(scope="module")
def normalized(spark, small_dir):
    a = src.audit_queries(spark, small_dir)
    return aud.normalize_events(a, aud.registry_frame(spark))


@pytest.fixture(scope="module")
def chained(normalized):
    return aud.chain_events(normalized).cache()


def test_verify_of_chain_has_no_breaks(chained):
    v = aud.verify_chain(chained)
    assert v.count() == chained.count() > 0
    assert aud.broken_links(v).count() == 0


def test_links_follow_previous_hash(chained):
    rows = sorted(chained.collect(), key=lambda r: (r.source_system, r.seg_hour, r.ts, r.event_id))
    for a, b in zip(rows, rows[1:]):
        if (a.source_system, a.seg_hour) == (b.source_system, b.seg_hour):
            assert b.previous_hash == a.this_hash


def test_one_flipped_byte_breaks_the_chain(chained):
    victim = chained.orderBy("event_id").first().event_id
    bad = chained.withColumn("doc", F.when(F.col("event_id") == victim,
                                           F.regexp_replace("doc", '"outcome":"S', '"outcome":"T'))
                             .otherwise(F.col("doc")))
    broken = aud.broken_links(aud.verify_chain(bad)).collect()
    assert len(broken) >= 1 and victim in {r.event_id for r in broken}


def test_deleted_event_breaks_next_link(chained):
    w = chained.groupBy("source_system", "seg_hour").count().filter("count >= 3").first()
    seg = chained.filter((F.col("source_system") == w.source_system) & (F.col("seg_hour") == w.seg_hour)) \
                 .orderBy("ts", "event_id").collect()
    gone = chained.filter(F.col("event_id") != seg[1].event_id)
    broken = {r.event_id for r in aud.broken_links(aud.verify_chain(gone)).collect()}
    assert seg[2].event_id in broken


def test_chain_continues_from_heads(normalized):
    cut = dt.datetime(2024, 1, 15)
    first = aud.chain_events(normalized.filter(F.col("ts") < cut)).cache()
    heads = aud.chain_heads(first)
    second = aud.chain_events(normalized.filter(F.col("ts") >= cut), heads)
    assert aud.broken_links(aud.verify_chain(second, heads)).count() == 0
    assert aud.broken_links(aud.verify_chain(first)).count() == 0


def test_every_event_is_chained(spark, small_dir):
    a = src.audit_queries(spark, small_dir).orderBy("event_id").limit(60).cache()
    ids = [r.event_id for r in a.select("event_id").orderBy("event_id").collect()]
    odd = dict(zip(ids, [None, "no.such.type", "secret.read", "identity.role.assigned"]))
    kind = F.col("event_type")
    for i, t in odd.items():
        kind = F.when(F.col("event_id") == i, F.lit(t)).otherwise(kind)
    when = F.when(F.col("event_id") != ids[4], F.col("timestamp"))  # one without a timestamp
    events = aud.normalize_events(a.withColumn("event_type", kind).withColumn("timestamp", when), aud.registry_frame(spark))
    got = {r.event_id: (r.source_system, r.event.event_type) for r in events.collect()}
    assert [got[i] for i in odd] == [("unknown", "unknown"), ("unknown", "no.such.type"), ("openbao", "secret.read"),
                                     ("keycloak", "identity.role.assigned")]
    chained = aud.chain_events(events).cache()
    v = aud.verify_chain(chained)
    assert sorted(r.event_id for r in chained.collect()) == sorted(r.event_id for r in v.collect()) == ids
    assert aud.broken_links(v).count() == 0
    lost = aud.verify_chain(chained.withColumn("source_system", F.lit(None).cast("string")))
    assert lost.count() == 60 and aud.broken_links(lost).count() > 0
    assert aud.chain_events(events.withColumn("source_system", F.lit(None).cast("string"))).count() == 60


def test_registry_holds_the_reference_types(spark):
    types = [t for t, _, _ in aud.CANONICAL_TYPES]
    assert len(set(types)) == 45 and aud.registry_frame(spark).groupBy("raw_type").count().filter("count > 1").isEmpty()


def test_risk_flags(spark):
    a = spark.createDataFrame([
        ("e1", "u1", "tenant_a", dt.datetime(2024, 1, 1), ["tenant_b.marts.customers"]),
        ("e2", "u1", "tenant_a", dt.datetime(2024, 1, 2), ["tenant_b.marts.customers"]),
        ("e3", "u2", "tenant_a", dt.datetime(2024, 1, 2), ["tenant_a.marts.orders"]),
    ], "event_id string, username string, tenant_id string, timestamp timestamp_ntz, tables_accessed array<string>")
    got = {r.event_id: (r.risk_level, r.risk_flags) for r in aud.flag_risk(a).collect()}
    per_table = aud.first_access(a.select("username", "timestamp", F.explode("tables_accessed").alias("table_name")))
    assert sorted(r.first_time for r in per_table.collect()) == [False, True, True]
    assert got["e1"] == ("CRITICAL", ["CROSS_TENANT_ACCESS", "FIRST_TIME_ACCESS", "PII_ACCESS"])
    assert got["e2"] == ("CRITICAL", ["CROSS_TENANT_ACCESS", "PII_ACCESS"])
    assert got["e3"] == ("MEDIUM", ["FIRST_TIME_ACCESS"])


def test_append_only_violations(spark):
    b = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    a = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "id long, v string")
    assert [tuple(r) for r in aud.append_only_violations(b, a).collect()] == [(2, "b")]


# ---------------------------------------------------------------------------
# Telemetry
# ---------------------------------------------------------------------------

def test_histogram_quantile_interpolates(spark):
    le = (1.0, 2.0, 4.0)
    df = spark.createDataFrame([([10, 30, 40, 40],)], "cum array<bigint>")
    r = df.select(tm.histogram_quantile(0.5, F.col("cum"), le).alias("p50"),
                  tm.histogram_quantile(0.99, F.col("cum"), le).alias("p99"),
                  tm.histogram_quantile(0.1, F.col("cum"), le).alias("p10")).first()
    assert r.p50 == pytest.approx(1.5) and r.p10 == pytest.approx(0.4) and r.p99 == pytest.approx(3.92)
    inf = spark.createDataFrame([([0, 0, 0, 5],)], "cum array<bigint>")
    assert inf.select(tm.histogram_quantile(0.5, F.col("cum"), le)).first()[0] == 4.0


def test_sustained_islands(spark):
    s = spark.createDataFrame([("j", b, v) for b, v in [(1, 1.0), (2, 1.0), (3, 1.0), (5, 1.0), (6, 0.0)]],
                              "job string, bucket long, x double")
    out = tm.sustained(s, ["job"], F.col("x") > 0.5, 300, 15).collect()
    assert len(out) == 1 and out[0].minutes == 15.0


def test_counter_reset(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("i", t0 + dt.timedelta(seconds=60 * k), v) for k, v in enumerate([10, 70, 5])],
                              "instance string, ts timestamp_ntz, c long")
    out = [(r.increase, r.per_second) for r in tm.counter_rate(s, ["instance"], "ts", "c").orderBy("ts").collect()]
    assert out == [(60, 1.0), (5, 5 / 60)]


def test_parse_logs_json_and_text(spark):
    lines = spark.createDataFrame([
        (1, "trino", '{"timestamp":"2024-01-01T00:00:01.500","level":"INFO","logger":"a.b","message":"hi","event_type":"click"}'),
        (2, "ranger-admin", "2024-01-01 00:00:02,250 WARN [t-1] org.x - denied access"),
        (3, "trino", "GET /metrics/prometheus 200"), (4, "minio", "   "),
    ], "line_id long, service string, body string")
    rows = {r.line_id: r for r in tm.parse_logs(tm.drop_noise(lines)).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].level, rows[1].event_type, rows[1].log_ts) == ("INFO", "click", dt.datetime(2024, 1, 1, 0, 0, 1, 500000))
    assert (rows[2].level, rows[2].thread, rows[2].logger, rows[2].message) == ("WARN", "t-1", "org.x", "denied access")


# ---------------------------------------------------------------------------
# Documents
# ---------------------------------------------------------------------------

def test_html_to_text(spark):
    html = ('<html><head><title>T &amp; U</title><style>p{x:1}</style><script>var a="</p>";</script></head>'
            '<body><p>Hello&nbsp;<b>world</b></p><!-- c --><div>x &lt; y</div></body></html>')
    out = spark.createDataFrame([(html,)], "h string").select(docs.html_to_text(F.col("h"))).first()[0]
    assert out == "T & U\nHello world\nx < y"


def test_page_count_and_paths(spark):
    df = spark.createDataFrame([("a\fb\fc", "uploads/my report (final).pdf")], "t string, k string")
    r = df.select(docs.page_count(F.col("t")).alias("p"), docs.extracted_path(F.col("k"), F.lit("run-1")).alias("e"),
                  docs.raw_object_path(F.col("k"), F.lit("run-1")).alias("r")).first()
    assert r.p == 3
    assert r.e == "documents/my report (final)/run-1/extracted.json"
    assert r.r == "raw/documents/my report (final)/run-1/my report (final).pdf"


def test_chunks_keep_every_sentence_once(spark, small_dir):
    d = src.read_table(spark, small_dir, "documents").limit(30)
    chunks = docs.chunk_documents(d, 500)
    per_doc = chunks.groupBy("doc_id").agg(F.sum("n_sentences").alias("n"))
    sent = d.select("doc_id", F.size(docs.sentences(F.col("text"))).alias("n"))
    assert per_doc.join(sent, ["doc_id", "n"], "left_anti").count() == 0
