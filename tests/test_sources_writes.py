"""Readers and sinks (S2, S4, S8-S10, S12, S14, S15, T7, T8, P7) on scratch folders."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeweave.functions.columns import truncate_bucket
from lakeweave.operators import tables as tbl
from lakeweave.plans import registry as R
from lakeweave.sources import documents as docs
from lakeweave.sources import landing as ld
from lakeweave.sources import tables as src


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="lakeweave-test-")


def test_read_extracted_filters_run_and_reads_all_files(spark, scratch):
    # Every file of the run, no cap, run decided by the record
    for i in range(5):
        rec = {"source_key": f"uploads/s/{i}.txt", "source_bucket": "incoming", "extracted_text": "t\fu",
               "page_count": 2, "run_id": "run-a" if i < 4 else "run-b", "metadata": "{}"}
        with open(os.path.join(scratch, f"{i}.json"), "w") as f:
            f.write(json.dumps(rec))
    df = ld.read_extracted(spark, scratch, "run-a")
    assert df.count() == 4 and set(df.columns) >= {"source_key", "extracted_text", "page_count"}


def test_read_landing_formats(spark, scratch):
    # JSON / CSV / Parquet / ORC with a declared schema
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for fmt in ("json", "csv", "parquet", "orc"):
        path = os.path.join(scratch, fmt)
        df.write.format(fmt).save(path)
        back = ld.read_landing(spark, path, fmt, "id long, v string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    xml = os.path.join(scratch, "xml")  # built into Spark 4
    df.write.format("xml").option("rowTag", "rec").save(xml)
    back = ld.read_landing(spark, xml, "xml", "id long, v string", rowTag="rec")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        ld.read_landing(spark, scratch, "avro")
    with pytest.raises(ValueError):
        ld.read_landing(spark, scratch, "csv")  # text formats need a schema


def test_write_raw_documents_partitioned_and_truncated(spark, scratch, small_dir):
    # S8 / D6
    raw = docs.raw_documents(spark, small_dir)
    docs.write_raw_documents(raw, scratch, max_chars=100)
    assert sorted(p for p in os.listdir(scratch) if p.startswith("run_id=")) == [f"run_id=run-{i}" for i in range(4)]
    back = spark.read.parquet(scratch)
    assert back.count() == raw.count() and back.agg(F.max(F.length("extracted_text"))).first()[0] <= 100


def test_ctas_append_layout(spark, scratch, small_dir):
    items = src.order_items(spark, small_dir)
    ld.ctas_sample(items, 50, os.path.join(scratch, "ctas"), order=["item_id", "product_id", "updated_at"])  # S9
    assert spark.read.parquet(os.path.join(scratch, "ctas")).count() == 50
    target = os.path.join(scratch, "append")  # S10 batched inserts
    for k in range(3):
        ld.append(items.filter(F.col("line_number") == k + 1), target)
    assert spark.read.parquet(target).count() == items.filter("line_number <= 3").count()
    laid = os.path.join(scratch, "layout")  # S12 truncate(order_id, 1000) partitions, sorted
    ld.write_layout(items, laid, {"order_bucket": truncate_bucket("order_id", 1000)}, sort=["order_id"])
    parts = [p for p in os.listdir(laid) if p.startswith("order_bucket=")]
    assert len(parts) == items.select(truncate_bucket("order_id", 1000)).distinct().count()


def test_archive_events_by_source_and_hour(spark, scratch, small_dir):
    # Gzip NDJSON, one folder per source / y / m / d / h
    a = src.audit_queries(spark, small_dir).withColumn("source_system", F.lit("trino"))
    ld.archive_events(a.limit(200), scratch)
    files = [os.path.join(r, f) for r, _, fs in os.walk(scratch) for f in fs if f.endswith(".json.gz")]
    assert files and all("/source=trino/y=2024/m=1/" in f for f in files)
    assert spark.read.json(scratch).count() == 200


def test_export_subject(spark, scratch, small_dir):
    # One subject, one folder per table, csv
    out = ld.export_subject({"stg_customers": R.stg_customers_df(spark, small_dir)}, {"stg_customers": "customer_id"},
                            "CUST-000001", scratch, "csv")
    back = spark.read.option("header", True).csv(out["stg_customers"])
    assert [r.customer_id for r in back.collect()] == ["CUST-000001"]


def test_compact_and_promote(spark, scratch, small_dir):
    # T7 rewrite into a new folder, T8 promotion overwrite
    src_dir, dst_dir = os.path.join(scratch, "many"), os.path.join(scratch, "compacted")
    src.order_items(spark, small_dir).repartition(20).write.parquet(src_dir)
    n = tbl.compact(spark, src_dir, dst_dir, target_bytes=1 << 30)
    assert n == 1 and spark.read.parquet(dst_dir).count() == spark.read.parquet(src_dir).count()
    tbl.promote(spark.read.parquet(dst_dir), os.path.join(scratch, "staging"))
    tbl.promote(spark.read.parquet(dst_dir).limit(10), os.path.join(scratch, "staging"))
    staging = os.path.join(scratch, "staging")
    assert tbl.read_promoted(spark, staging).count() == 10
    assert spark.read.parquet(f"{staging}/v=0").count() > 10  # the state before stays readable
    os.makedirs(f"{staging}/v=2")  # a promotion that did not end is not seen
    assert tbl.read_promoted(spark, staging).count() == 10
    with pytest.raises(ValueError):
        tbl.read_promoted(spark, os.path.join(scratch, "nothing"))


def test_hot_partition_is_written_by_several_tasks_and_runs_are_pruned(spark, scratch):
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("source_key"), F.sha2(F.col("id").cast("string"), 512).alias("extracted_text"),
                                      F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 9)).alias("run_id"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        docs.write_raw_documents(rows, f"{scratch}/raw")
        ld.write_extracted(rows, f"{scratch}/json")
    finally:
        spark.conf.unset(size)
    files = lambda run: [f for f in os.listdir(f"{scratch}/raw/run_id={run}") if f.endswith(".parquet")]
    assert len(files("hot")) > 3
    one = ld.read_extracted(spark, f"{scratch}/json", "r1")
    assert one.count() == 2223 and one.columns == ld.EXTRACTED_SCHEMA.names
    assert "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().executedPlan().toString()


def test_literal_select(spark):
    # Typed constants
    r = spark.sql("SELECT 42 AS answer, 'hello' AS greeting, true AS flag").first()
    assert (r.answer, r.greeting, r.flag) == (42, "hello", True)


def test_upsert_batch_is_idempotent(spark, scratch):
    # Re-running a micro-batch id overwrites its own version
    from lakeweave.streaming.streams import latest_version, upsert_batch
    fn = upsert_batch(scratch, ["id"])
    b0 = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    b1 = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    fn(b0, 0)
    fn(b1, 1)
    fn(b1, 1)  # replay after a failure
    cur = spark.read.parquet(latest_version(spark, scratch))
    assert sorted(map(tuple, cur.collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_generators_over_fixture_keys(spark, small_dir):
    # Generator formulas driven by the keys of the given tables
    from lakeweave.sources import generators as gen
    part = src.read_table(spark, small_dir, "part").select(F.col("p_partkey").alias("seq"))
    p = gen.generate_products(part)
    assert p.count() == part.count() and p.filter(~F.col("sku").rlike(r"^SKU-[0-9]{6,}$")).count() == 0
    assert {r.category for r in p.select("category").distinct().collect()} <= set(gen.PRODUCT_CATEGORIES)
    o = gen.generate_orders(src.read_table(spark, small_dir, "orders").select(F.col("o_orderkey").alias("seq")), 1200)
    assert o.filter(F.col("ship_date") <= F.col("order_date")).count() == 0
    items = gen.generate_order_items(src.read_table(spark, small_dir, "lineitem")
                                     .select(F.monotonically_increasing_id().alias("seq")), 250)
    assert items.filter((F.col("quantity") < 1) | (F.col("quantity") > 5)).count() == 0
    c = gen.generate_customers(src.read_table(spark, small_dir, "customer").select(F.col("c_custkey").alias("seq")))
    assert c.filter(~F.col("ssn").rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).count() == 0
