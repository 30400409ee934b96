"""Dimensional, incremental and maintenance table operators
(T1, T4-T10, W1, W6, W8, S16, A14).

There is no table-format jar in the runtime, so merge and time travel are
copy-on-write DataFrame operators over a change log. "Latest row per key" is
written as ``max(struct(order..., payload...))`` grouped by the key: a hash
aggregate with map-side partial aggregation, so a key holding a third of all
rows is reduced before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import ts_lit


def _assert_unique_keys(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Lazily fail the job when a key occurs twice. The window is partitioned
    by the merge keys, so it reuses the exchange the following join needs."""
    w = Window.partitionBy(*keys)
    # a filter predicate, not a projected column: Catalyst would prune an
    # unused column together with its raise_error
    whole = F.lit(True)
    for k in keys:  # a NULL key matches nothing, so it is never a duplicate
        whole = whole & F.col(k).isNotNull()
    return (df.withColumn("__n", F.count(F.lit(1)).over(w))
              .filter(F.when(whole & (F.col("__n") > 1), F.raise_error(F.lit(f"duplicate keys in {what}")))
                      .otherwise(F.lit(True)))
              .drop("__n"))


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                 check_duplicates: bool = True) -> DataFrame:
    """T1 (with J5): matched rows take the update, unmatched updates are
    inserted, the rest of the target stays. NULL keys never match.
    Duplicate update keys raise when the plan runs."""
    keys = list(keys)
    upd = _assert_unique_keys(updates, keys, "merge source") if check_duplicates else updates
    upd = upd.select(*target.columns)
    key_only = upd.select(*keys)
    kept = target.join(key_only, keys, "left_anti")
    return kept.unionByName(upd)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   tie_break: Sequence[str] | None = None) -> DataFrame:
    """Shared core of W1/T4: the row with the greatest (order, tie_break)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    tb = list(tie_break) if tie_break is not None else [c for c in rest if c not in order]
    fields = list(order) + [c for c in tb if c not in order]
    fields += [c for c in rest if c not in fields]
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    best = df.groupBy(*keys).agg(F.max(packed).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.f{fields.index(c)}").alias(c) for c in rest]) \
               .select(*df.columns)


def dedupe_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  tie_break: Sequence[str] | None = None) -> DataFrame:
    """Keep the latest row per key; remaining columns break ties, so the
    result is deterministic."""
    return latest_per_key(df, keys, order, tie_break)


# ---------------------------------------------------------------------------
# Change log, time travel, snapshots
# ---------------------------------------------------------------------------

def order_changes(orders: DataFrame) -> DataFrame:
    """Fixture change log: one commit per order month (FIXTURES.md §2).

    Every order is inserted in the commit of its month; every 5th is updated
    one commit later (status 'F'); every 13th is deleted two commits later."""
    month_no = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("bigint")
    base = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                         "o_orderstatus", "o_totalprice", month_no.alias("m"))

    def commit(m: Column) -> list[Column]:
        return [m.alias("version"),
                F.make_timestamp_ntz(1995 + F.floor((m - 1) / 12).cast("int"),
                                     ((m - 1) % 12 + 1).cast("int"), F.lit(28), F.lit(12), F.lit(0), F.lit(0))
                 .alias("committed_at")]

    ins = base.select("order_id", *commit(F.col("m")), F.lit("I").alias("op"), "customer_id",
                      F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    upd = base.filter(F.col("order_id") % 5 == 0).select(
        "order_id", *commit(F.col("m") + 1), F.lit("U").alias("op"), "customer_id",
        F.lit("F").alias("status"), (F.col("o_totalprice") + 1).alias("amount"))
    dele = base.filter(F.col("order_id") % 13 == 0).select(
        "order_id", *commit(F.col("m") + 2), F.lit("D").alias("op"), "customer_id",
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("amount"))
    return ins.unionByName(upd).unionByName(dele)


def as_of(changes: DataFrame, keys: Sequence[str], version: int | None = None,
          ts: str | dt.datetime | None = None, version_col: str = "version",
          ts_col: str = "committed_at", op_col: str = "op") -> DataFrame:
    """T4: table state at a version or timestamp, from an append-only change log.

    A timestamp before the first commit raises (lazily, inside the plan)."""
    c = changes
    if version is not None:
        c = c.filter(F.col(version_col) <= F.lit(version))
    if ts is not None:
        first = changes.agg(F.min(ts_col).alias("__first"))
        c = (c.filter(F.col(ts_col) <= ts_lit(ts)).crossJoin(F.broadcast(first))
              .filter(F.when(ts_lit(ts) < F.col("__first"),
                             F.raise_error(F.lit("timestamp is before the first snapshot"))).otherwise(F.lit(True)))
              .drop("__first"))
    latest = latest_per_key(c, keys, [version_col], tie_break=[])
    return latest.filter(F.col(op_col) != "D").drop(op_col)


def snapshot_log(changes: DataFrame, table: str = "orders", version_col: str = "version",
                 ts_col: str = "committed_at", op_col: str = "op") -> DataFrame:
    """One row per snapshot (commit) with its operation counts."""
    return changes.groupBy(F.col(version_col).alias("snapshot_id")).agg(
        F.min(ts_col).alias("committed_at"),
        F.sum(F.when(F.col(op_col) == "I", 1).otherwise(0)).cast("bigint").alias("added_records"),
        F.sum(F.when(F.col(op_col) == "U", 1).otherwise(0)).cast("bigint").alias("updated_records"),
        F.sum(F.when(F.col(op_col) == "D", 1).otherwise(0)).cast("bigint").alias("deleted_records"),
    ).withColumn("table_name", F.lit(table))


def expirable(snapshots: DataFrame, now: str | dt.datetime, older_than_days: int = 7,
              retain_last: int = 5, table_col: str = "table_name") -> DataFrame:
    """T5 with W6: snapshots older than N days, never one of the last K per table."""
    w = Window.partitionBy(table_col).orderBy(F.col("committed_at").desc(), F.col("snapshot_id").desc())
    ranked = snapshots.withColumn("recency_rank", F.row_number().over(w))
    cutoff = ts_lit(now) - F.make_interval(days=F.lit(older_than_days))
    return ranked.withColumn("expire", (F.col("recency_rank") > retain_last) & (F.col("committed_at") < cutoff))


def lineitem_files(lineitem: DataFrame, rows_per_file: int = 1000, bytes_per_row: int = 120) -> DataFrame:
    """Fixture file listing: one data file per lineitem chunk of order keys."""
    chunk = F.floor(F.col("l_orderkey") / rows_per_file)
    month = F.date_format(F.col("l_shipdate"), "yyyy-MM")
    return (lineitem.groupBy(month.alias("partition"), chunk.alias("chunk"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("modified_at"))
            .select(F.concat(F.lit("lineitem/ship_month="), F.col("partition"), F.lit("/chunk-"),
                             F.col("chunk").cast("string"), F.lit(".parquet")).alias("path"),
                    "partition", (F.col("n") * bytes_per_row).alias("size_bytes"), "modified_at"))


def orphan_files(listing: DataFrame, referenced: DataFrame, now: str | dt.datetime,
                 older_than_days: int = 3) -> DataFrame:
    """Files on storage that no snapshot references and that are old enough."""
    cutoff = ts_lit(now) - F.make_interval(days=F.lit(older_than_days))
    return (listing.join(referenced.select("path").distinct(), "path", "left_anti")
            .filter(F.col("modified_at") < cutoff))


def compaction_plan(files: DataFrame, min_files: int = 10, target_bytes: int = 1 << 30,
                    partition_col: str = "partition") -> DataFrame:
    """T7 plan: partitions with at least ``min_files`` files, bin-packed into
    rewrite groups of up to ``target_bytes`` (first-fit in path order)."""
    per_part = Window.partitionBy(partition_col)
    order = Window.partitionBy(partition_col).orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    f = files.withColumn("files_in_partition", F.count(F.lit(1)).over(per_part)) \
             .filter(F.col("files_in_partition") >= min_files)
    f = f.withColumn("cum_bytes", F.sum("size_bytes").over(order))
    return f.withColumn("rewrite_group",
                        F.floor((F.col("cum_bytes") - F.col("size_bytes")) / F.lit(target_bytes)).cast("bigint"))


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = 1 << 30) -> int:
    """T7 rewrite: read a directory and write it back with files near the
    target size into a *new* directory. Returns the number of output files."""
    df = spark.read.parquet(src)
    # size from the file system the table lives on (HDFS, object store, local)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(src)
    total = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    n = max(1, -(-int(total) // target_bytes))
    df.repartition(n).write.mode("overwrite").parquet(dst)
    return n


def diff_versions(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted / updated / deleted going from ``a`` to ``b``."""
    keys = list(keys)
    vals = [c for c in a.columns if c not in keys]
    aa = a.select(*keys, F.struct(*vals).alias("__a"))
    bb = b.select(*keys, F.struct(*vals).alias("__b"))
    j = aa.join(bb, keys, "full_outer")
    change = (F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "deleted")
              .when(~F.col("__a").eqNullSafe(F.col("__b")), "updated"))
    return (j.withColumn("change_type", change).filter(F.col("change_type").isNotNull())
             .select(*keys, "change_type",
                     *[F.coalesce(F.col(f"__b.{c}"), F.col(f"__a.{c}")).alias(c) for c in vals]))


def promote(df: DataFrame, path: str) -> str:
    """T8 promotion: a branch state becomes the table's next version. It is written to a folder of its own
    (``v=<n>``), and readers (:func:`read_promoted`) see it once its ``_SUCCESS`` file is there, so nobody reads
    half a state and the state before stays readable. Returns the folder."""
    from lakeweave.streaming.streams import latest_version

    last = latest_version(df.sparkSession, path)
    target = f"{path.rstrip('/')}/v={int(last.rsplit('=', 1)[1]) + 1 if last else 0}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_promoted(spark: SparkSession, path: str) -> DataFrame:
    from lakeweave.streaming.streams import latest_version

    last = latest_version(spark, path)
    if last is None:
        raise ValueError(f"no complete version in {path}")
    return spark.read.parquet(last)


def retention_policy(spark: SparkSession) -> DataFrame:
    """T9 policy rows. Retention per layer in days (NULL keeps
    for ever): raw 90, staging 30, curated NULL, quarantine 30, audit 2555."""
    return spark.createDataFrame(
        [("raw", 90), ("staging", 30), ("curated", None), ("quarantine", 30), ("audit", 2555)],
        "layer string, retention_days int")


def apply_retention(df: DataFrame, ts_col: str, layer_col: str, policy: DataFrame,
                    now: str | dt.datetime, hold_col: str | None = None) -> DataFrame:
    """Keep rows within their layer's retention, rows under legal hold,
    rows of layers without a limit, and rows without a timestamp, whose age is
    not known. The policy is a handful of hand-written
    rows, so it is broadcast."""
    j = df.join(F.broadcast(policy.withColumnRenamed("layer", "__layer")),
                F.col(layer_col) == F.col("__layer"), "left")
    keep = (F.col("retention_days").isNull() | F.col(ts_col).isNull()
            | (F.col(ts_col) >= ts_lit(now) - F.make_interval(days=F.col("retention_days"))))
    if hold_col:
        keep = keep | F.coalesce(F.col(hold_col), F.lit(False))
    return j.filter(keep).drop("__layer", "retention_days")


def describe_tables(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> DataFrame:
    """Catalog listing (table, column, type, position) from the file
    schemas. Only metadata crosses the driver."""
    rows = []
    for name in names:
        schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
        for i, fld in enumerate(schema.fields):
            rows.append((name, fld.name, fld.dataType.simpleString(), i + 1))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")


def scd2(changes: DataFrame, keys: Sequence[str], updated_at: str, tracked: Sequence[str],
         bucket_days: int | None = 30) -> DataFrame:
    """Type-2 history. Versions that repeat the previous tracked values
    are collapsed; each kept version gets valid_from / valid_to / is_current.

    Skew: with ``bucket_days`` the lag / lead windows run per (key, time
    bucket), so an entity with a huge history is spread over many tasks. The
    neighbours across a bucket boundary come from a per-bucket aggregate
    (first / last version) and a lag / lead over the key's bucket series,
    whose length is bounded by the time range. ``bucket_days=None`` uses one
    window per key. Of versions with one time the tracked values decide the order;
    all but the last are valid for no time."""
    keys = list(keys)
    sig = F.struct(*[F.col(c) for c in tracked])
    if bucket_days is None:
        w = Window.partitionBy(*keys).orderBy(F.col(updated_at), *tracked)
        marked = changes.withColumn("__prev", F.lag(sig).over(w))
        kept = marked.filter(F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(sig)).drop("__prev")
        return (kept.withColumn("valid_from", F.col(updated_at))
                    .withColumn("valid_to", F.lead(updated_at).over(w))
                    .withColumn("is_current", F.col("valid_to").isNull()))

    from lakeweave.functions.columns import bucket_number
    kb = keys + ["__b"]
    c = changes.withColumn("__b", bucket_number(updated_at, bucket_days * 86400))
    wb = Window.partitionBy(*kb).orderBy(F.col(updated_at), *tracked)
    series = Window.partitionBy(*keys).orderBy("__b")

    # pass 1: previous signature, across bucket boundaries
    last_sig = c.groupBy(*kb).agg(F.max_by(sig, F.struct(F.col(updated_at), sig)).alias("__last_sig"))
    last_sig = last_sig.withColumn("__prev_bucket_sig", F.lag("__last_sig").over(series)).drop("__last_sig")
    marked = (c.withColumn("__prev", F.lag(sig).over(wb))
               .join(last_sig, kb, "left")
               .withColumn("__prev", F.coalesce("__prev", "__prev_bucket_sig")))
    kept = marked.filter(F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(sig)) \
                 .drop("__prev", "__prev_bucket_sig")

    # pass 2: next kept version, across bucket boundaries
    first_kept = kept.groupBy(*kb).agg(F.min(updated_at).alias("__first_ts"))
    first_kept = first_kept.withColumn("__next_bucket_ts", F.lead("__first_ts").over(series)).drop("__first_ts")
    out = (kept.withColumn("valid_to", F.lead(updated_at).over(wb))
               .join(first_kept, kb, "left")
               .withColumn("valid_to", F.coalesce("valid_to", "__next_bucket_ts"))
               .drop("__next_bucket_ts", "__b"))
    return (out.withColumn("valid_from", F.col(updated_at))
               .withColumn("is_current", F.col("valid_to").isNull())
               .select(*changes.columns, "valid_from", "valid_to", "is_current"))


def maintenance_report(expire: DataFrame, orphans_df: DataFrame, plan: DataFrame) -> DataFrame:
    """Per-table counts of what maintenance would do."""
    e = expire.filter("expire").groupBy("table_name").agg(F.count(F.lit(1)).alias("n")) \
              .withColumn("action", F.lit("expire_snapshots"))
    o = orphans_df.groupBy(F.regexp_extract("path", r"^([^/]+)/", 1).alias("table_name")) \
                  .agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.lit("remove_orphan_files"))
    p = plan.groupBy(F.regexp_extract("path", r"^([^/]+)/", 1).alias("table_name")) \
            .agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.lit("rewrite_data_files"))
    return e.unionByName(o).unionByName(p).select("table_name", "action", F.col("n").cast("bigint").alias("n"))
