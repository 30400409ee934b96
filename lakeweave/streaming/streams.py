"""Structured Streaming forms of the lake's near-stream behaviour.

Conventions:
* event time is cast from the fixtures' TIMESTAMP_NTZ to TIMESTAMP for the
  watermark (Spark requires it) and back to NTZ on output;
* sinks and checkpoints live under the shared folder named by the session's
  ``spark.checkpoint.dir`` (never a machine-local temporary folder), so a
  restarted query resumes exactly once;
* ``run_available`` drives a query with ``trigger(availableNow=True)``: all
  data present at start is processed in bounded micro-batches, then it stops.
"""

from __future__ import annotations

import uuid
from datetime import timedelta
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeweave.functions.columns import epoch_micros, from_epoch_micros, ts_lit
from lakeweave.operators.tables import dedupe_latest, merge_upsert
from lakeweave.operators.trail import (CHAIN_SCHEMA, LATE, NO_HOUR, chain_templates, last_heads, seal_segments,
                                       templates)
from lakeweave.session import ensure_checkpoint_dir, materialize


def stream_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one query's sink and checkpoint in the shared area."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def read_files(spark: SparkSession, path: str, fmt: str, schema: StructType, glob: str | None = None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """X1 source: new files of a folder, with a declared schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def read_fixture_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return read_files(spark, sf_dir, "parquet", schema, glob=f"{table}.parquet")


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """NTZ event time -> TIMESTAMP for watermarks, through epoch micros so the
    result does not depend on the session time zone."""
    return df.withColumn(col, F.timestamp_micros(epoch_micros(col)))


def ntz(c: Column) -> Column:
    """TIMESTAMP -> NTZ through epoch micros (inverse of ``event_time``)."""
    return from_epoch_micros(F.unix_micros(c))


def run_available(query_builder, checkpoint: str) -> StreamingQuery:
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_parquet(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to a Parquet sink and read the result back."""
    base = stream_dir(spark, name)
    run_available(df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out"), f"{base}/ck")
    return spark.read.schema(df.schema).parquet(f"{base}/out")


# ---------------------------------------------------------------------------
# Windowed aggregates (X2, X3) and late data
# ---------------------------------------------------------------------------

def windowed_rate(events: DataFrame, key: str, ts: str = "ts", size: str = "5 minutes",
                  watermark: str = "10 minutes") -> DataFrame:
    """Events per key in tumbling windows; emitted once the watermark
    passes the window end (append mode), late rows dropped by the watermark."""
    return (events.withWatermark(ts, watermark)
                  .groupBy(F.window(ts, size).alias("w"), key)
                  .agg(F.count(F.lit(1)).alias("events"))
                  .select(key, ntz(F.col("w.start")).alias("window_start"),
                          ntz(F.col("w.end")).alias("window_end"), "events"))


def sliding_success_ratio(events: DataFrame, key: str, failed: str, ts: str = "ts", size: str = "1 hour",
                          slide: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Success ratio over a sliding window (1 h every 5 m). Each row
    lands in size/slide windows (12 here), a constant factor."""
    return (events.withWatermark(ts, watermark)
                  .groupBy(F.window(ts, size, slide).alias("w"), key)
                  .agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col(failed), 1)).alias("failures"))
                  .select(key, ntz(F.col("w.start")).alias("window_start"),
                          ntz(F.col("w.end")).alias("window_end"), "requests", "failures",
                          ((F.col("requests") - F.col("failures")) / F.col("requests")).alias("success_ratio")))


def split_late(df: DataFrame, ts: str, now: str, max_age_hours: int = 168) -> tuple[DataFrame, DataFrame]:
    """X4 batch branch: (accepted, rejected) by sample age against ``now``."""
    cutoff = ts_lit(now) - F.make_interval(hours=F.lit(max_age_hours))
    late = F.coalesce(F.col(ts) < cutoff, F.lit(False))  # a row without a time is not known to be late
    return df.filter(~late), df.filter(late)


def late_batch(path: str, ts: str = "ts", max_age: str = "168 hours", keys: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """X4 as a stream: every row is kept, those older than ``max_age`` before the newest event time of all
    earlier batches (of the same ``keys``) as late ones. The newest times are the state: a partial
    aggregate of each batch, one version a batch id, so a replayed batch decides alike. Rows go to
    ``path/rows/batch_id=<n>/late=<true or false>``; a row without a time is not known to be late."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = latest_version(spark, f"{path}/marks", before=batch_id)
        marks = spark.read.parquet(before) if before else None
        age = F.expr(f"INTERVAL '{max_age}'")
        if marks is None:
            tagged = batch.withColumn("late", F.lit(False))
        else:
            m = marks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mark").alias("__mark"))
            same = F.lit(True)
            for k in keys:
                same = same & batch[k].eqNullSafe(m[f"__{k}"])
            tagged = batch.join(m if keys else F.broadcast(m), same, "left")  # without keys there is one mark
            tagged = tagged.withColumn("late", F.coalesce(F.col(ts) < F.col("__mark") - age, F.lit(False))).select(*batch.columns, "late")
        out = f"{path}/rows/batch_id={batch_id}"
        tagged.write.mode("overwrite").partitionBy("late").parquet(out)
        seen = spark.read.schema(tagged.schema).parquet(out).groupBy(*keys).agg(F.max(ts).alias("mark"))
        if marks is not None:
            seen = seen.unionByName(marks).groupBy(*keys).agg(F.max("mark").alias("mark"))
        seen.write.mode("overwrite").parquet(f"{path}/marks/v={batch_id}")
    return fn


def dedupe_stream(events: DataFrame, keys: Sequence[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Duplicate deliveries suppressed; state is kept only while the
    watermark can still see a duplicate."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


# ---------------------------------------------------------------------------
# foreachBatch sinks
# ---------------------------------------------------------------------------

def latest_version(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """Newest committed version folder of a copy-on-write table (optionally
    the newest one older than batch ``before``)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    versions = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hpath)
                      if s.getPath().getName().startswith("v=")
                      and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{s.getPath().toString()}/_SUCCESS")))
    if before is not None:
        versions = [v for v in versions if v < before]
    return f"{path.rstrip('/')}/v={versions[-1]}" if versions else None


def upsert_batch(path: str, keys: Sequence[str], order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Merge every micro-batch into a copy-on-write table. Each batch
    writes a new version folder ``v=<batch id>`` built from the newest
    version *before* it, so a replay of the same batch id after a failure
    rebuilds the same version (exactly once). Of several versions of a key in a
    batch the greatest row counts, compared by ``order`` and then all columns."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        batch = dedupe_latest(batch.filter(whole), keys, list(order)).unionByName(batch.filter(~whole))
        base = latest_version(spark, path, before=batch_id)
        target = f"{path.rstrip('/')}/v={batch_id}"
        merged = merge_upsert(spark.read.parquet(base), batch, keys) if base is not None else batch
        merged.write.mode("overwrite").parquet(target)
    return fn


def bucket_of(keys: Sequence[str], n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def upsert_buckets(path: str, keys: Sequence[str], order: Sequence[str] = (), n_buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """X6 / T3 for large marts: the table is cut by a hash of the key into buckets, each with a version of its own,
    and a batch writes only the buckets that it touches. ``current/v=<n>`` says which version of each bucket is
    valid; it is written last, so a batch is seen as a whole, and a replay of its id rebuilds the same.
    Bucket versions that neither this state nor the one before it names are deleted."""
    base = path.rstrip("/")

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = latest_version(spark, f"{base}/current", before=batch_id)
        current = spark.read.parquet(before) if before else None
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        rows = dedupe_latest(batch.filter(whole), keys, list(order)).unionByName(batch.filter(~whole)).withColumn("_bucket", bucket_of(keys, n_buckets))
        rows = materialize(rows, "batch")
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most n_buckets numbers
        valid = {r.bucket: r.version for r in current.collect()} if current else {}
        old = [f"{base}/data/v={valid[b]}/_bucket={b}" for b in sorted(touched & set(valid))]
        if old:
            had = spark.read.schema(batch.schema).parquet(*old)
            rows = merge_upsert(had, rows.drop("_bucket"), keys).withColumn("_bucket", bucket_of(keys, n_buckets))
        if touched:
            rows.repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{base}/data/v={batch_id}")
        now = valid | {b: batch_id for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{base}/current/v={batch_id}")
        for b in touched & set(valid):
            stale = [v for v in _versions_of(spark, base, b) if v not in (valid[b], now[b])]
            for v in stale:
                _delete(spark, f"{base}/data/v={v}/_bucket={b}")
    return fn


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions_of(spark: SparkSession, base: str, bucket: int) -> list[int]:
    p, fs = _fs(spark, f"{base}/data/v=*/_bucket={bucket}")
    return [int(s.getPath().getParent().getName().split("=")[1]) for s in (fs.globStatus(p) or [])]


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_buckets(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The table of :func:`upsert_buckets` after its last batch (or the last one before ``before``)."""
    base = path.rstrip("/")
    state = latest_version(spark, f"{base}/current", before=before)
    paths = [f"{base}/data/v={r.version}/_bucket={r.bucket}" for r in spark.read.parquet(state).collect()] if state else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _first_seen():
    import struct

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    record = "<16sq"  # hash of a key, its end

    class FirstSeen(StatefulProcessor):
        """Per bucket of keys the keys that have been delivered, in a list of pieces: a batch reads its buckets' pieces
        and adds one with its new keys. A timer at the bucket's next ``ends`` (event time in milliseconds; 0: never) takes
        away what is over."""

        def init(self, handle) -> None:
            self.handle = handle
            self.pieces = handle.getListState("pieces", "records binary")
            self.past = handle.getValueState("past", "ms long")  # keys that ended by then are forgotten

        def records(self) -> list:
            past = self.past.get()[0] if self.past.exists() else None
            return [r for (piece,) in self.pieces.get() for r in struct.iter_unpack(record, bytes(piece)) if not r[1] or past is None or r[1] > past]

        def handleInputRows(self, key, rows, timerValues):
            known, new = {k for k, _ in self.records()}, []
            for pdf in rows:
                again = []
                for k, ends in zip(pdf["hash"], pdf["ends"]):
                    again.append(k is not None and k in known)  # a row without a key is no repeat of another
                    if k is not None and not again[-1]:
                        known.add(k)
                        new.append((k, ends))
                yield pd.DataFrame({"payload": pdf["payload"], "again": again})
            if new:
                self.pieces.appendList([(b"".join(struct.pack(record, *r) for r in new),)])
                self.wake(new)

        def wake(self, records) -> None:
            if any(ends for _, ends in records):
                self.handle.registerTimer(int(min(ends for _, ends in records if ends)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.past.update((timerValues.getCurrentWatermarkInMs(),))
            left = self.records()
            if not left:
                self.pieces.clear()
            elif 2 * struct.calcsize(record) * len(left) < sum(len(piece) for (piece,) in self.pieces.get()):
                self.pieces.put([(b"".join(struct.pack(record, *r) for r in left),)])
            self.wake(left)
            return iter([])

        def close(self) -> None:
            pass

    return FirstSeen()


#: Rows pass state operators as JSON; these formats keep microseconds and nulls.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def mark_repeats(rows: DataFrame, keys: Sequence[str], ts: str | None = None, ttl: timedelta = timedelta(days=7),
                 delay: str = "1 hour", n_buckets: int = 1024) -> DataFrame:
    """X8 state: ``rows`` with ``_repeat``: whether the row's key was delivered before, in this or any earlier
    batch. With an event time ``ts`` (NTZ) a key is forgotten once the watermark, ``delay`` behind the newest row, is
    ``ttl`` past its first row; without one, never. Nothing is dropped: the first row read of a key passes, rows with a
    null in the key are no repeats, late rows are judged by what is still known. State (RocksDB) is
    24 bytes per key, told apart by 128 bits of its sha256, in ``n_buckets`` by hash: a batch calls Python once a bucket,
    not once a key, and rows of a hot key stream through."""
    schema = rows.schema
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    payload = F.to_json(F.struct(*rows.columns), _JSON)
    key = F.when(whole, F.substring(F.unhex(F.sha2(F.to_json(F.struct(*keys), _JSON), 256)), 1, 16))
    ends = F.lit(0).cast("long")
    timed = rows
    if ts is not None:
        timed = event_time(rows.withColumn("_time", F.col(ts)), "_time").withWatermark("_time", delay)
        ends = F.coalesce(F.unix_millis("_time") + int(ttl.total_seconds() * 1000), ends)
    keyed = timed.select(key.alias("hash"), payload.alias("payload"), ends.alias("ends"))
    marked = (keyed.withColumn("bucket", F.when(F.col("hash").isNull(), bucket_of(["payload"], n_buckets)).otherwise(bucket_of(["hash"], n_buckets))).groupBy("bucket")
              .transformWithStateInPandas(_first_seen(), "payload string, again boolean", "Append", "None" if ts is None else "EventTime"))
    return marked.select(F.from_json("payload", schema, _JSON).alias("_row"), F.col("again").alias("_repeat")).select("_row.*", "_repeat")


def quarantine_batch(path: str, suite: Sequence[dict], unique_keys: Sequence[str] = ()) -> Callable:
    """Split every micro-batch into good rows and quarantined rows with their reasons, one
    folder per batch id (``batch_id=<n>``), overwritten on replay: exactly once. Rows of
    :func:`mark_repeats` carry the state of all batches: a repeat has the reason ``duplicate:<keys>``; they are
    written once, as a second run of the state operator costs the same again and may choose another first row.
    Without it, ``unique_keys`` are held against the batch alone."""
    from lakeweave.operators.quality import split_quarantine

    def fn(batch: DataFrame, batch_id: int) -> None:
        marked = "_repeat" in batch.columns
        if marked:
            batch = materialize(batch, "marked")
        good, bad = split_quarantine(batch, suite, () if marked else unique_keys)
        if marked:
            tag = F.when(F.col("_repeat"), F.array(F.lit("duplicate:" + ",".join(unique_keys)))).otherwise(F.array().cast("array<string>"))
            repeats = good.filter("_repeat").withColumn("fail_reasons", tag)
            bad = bad.withColumn("fail_reasons", F.concat("fail_reasons", tag)).unionByName(repeats).drop("_repeat")
            good = good.filter("NOT _repeat").drop("_repeat")
        good.write.mode("overwrite").parquet(f"{path.rstrip('/')}/good/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{path.rstrip('/')}/quarantine/batch_id={batch_id}")
    return fn


# ---------------------------------------------------------------------------
# Streaming hash chain
# ---------------------------------------------------------------------------

def _segment_buffer(seconds: int):
    import pyarrow as pa
    from pyspark.sql.streaming import StatefulProcessor

    held = pa.schema([("ts_us", pa.int64()), ("event_id", pa.string()), ("query_id", pa.string()), ("template", pa.string())])
    columns = ["source_system", "seg_us", "ts_us", "event_id", "query_id", "template", "late"]

    class SegmentBuffer(StatefulProcessor):
        """Keyed by segment: its events wait in a list of Arrow batches, as they came, until a timer at the
        segment's end, which the watermark sets off, gives them out as a whole."""

        def init(self, handle) -> None:
            self.handle = handle
            self.events = handle.getListState("events", "batch binary")

        def handleInputRows(self, key, rows, timerValues):
            end = key[1] // 1000 + seconds * 1000
            late = end <= timerValues.getCurrentWatermarkInMs() and not self.events.exists()
            for pdf in rows:
                if late:
                    yield pdf.assign(late=True)[columns]
                else:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, held, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                        writer.write_table(pa.Table.from_pandas(pdf, held, preserve_index=False))
                    self.events.appendList([(sink.getvalue().to_pybytes(),)])
            if not late:
                self.handle.registerTimer(end)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            for (batch,) in self.events.get():
                yield pa.ipc.open_stream(batch).read_pandas().assign(source_system=key[0], seg_us=key[1], late=False)[columns]
            self.events.clear()

        def close(self) -> None:
            pass

    return SegmentBuffer()


def whole_segments(events: DataFrame, segment_seconds: int = 3600, delay: str = "2 hours") -> DataFrame:
    """Canonical events (a stream of ``normalize_events``) held back until their segment is over: the watermark,
    ``delay`` behind the newest event, has passed its end. Events of a segment that was over before they
    came have ``late``; none is dropped (the time is passed on without its watermark, or Spark would drop them)."""
    rows = templates(event_time(events.withColumn("_time", F.col("ts")), "_time").withWatermark("_time", delay), segment_seconds)
    flat = rows.select("source_system", epoch_micros("seg_hour").alias("seg_us"),
                       F.coalesce(epoch_micros("ts"), F.lit(NO_TIME)).alias("ts_us"), "event_id", "query_id", "template")
    out = flat.groupBy("source_system", "seg_us").transformWithStateInPandas(
        _segment_buffer(segment_seconds), "source_system string, seg_us long, ts_us long, event_id string, query_id string, template string, late boolean",
        "Append", "EventTime")
    return out.select("source_system", from_epoch_micros(F.col("seg_us")).alias("seg_hour"),
                      F.when(F.col("ts_us") != NO_TIME, from_epoch_micros(F.col("ts_us"))).alias("ts"), "event_id", "query_id", "template", "late")


NO_TIME = -(1 << 62)


def chain_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Links the segments of :func:`whole_segments` that a micro-batch ended, from the heads of the
    previous batch. Writes ``chain/batch=<n>``, ``seals/batch=<n>`` (to keep apart) and ``heads/v=<n>``. Segments end
    in order, so the result is the batch chain, row by row. Late events are linked as well: a batch's late
    events of a source are a segment of their own under ``<source>#late``, numbered by the batch."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark, base = batch.sparkSession, path.rstrip("/")
        heads_dir = latest_version(spark, f"{base}/heads", before=batch_id)
        heads = spark.read.parquet(heads_dir) if heads_dir else None
        late = F.col("late")
        rows = batch.select(F.when(late, F.concat("source_system", F.lit(LATE))).otherwise(F.col("source_system")).alias("source_system"),
                            F.when(late, ts_lit(NO_HOUR) + F.make_interval(secs=F.lit(batch_id))).otherwise(F.col("seg_hour")).alias("seg_hour"),
                            "ts", "event_id", "query_id", "template")
        chain_templates(rows, heads).write.mode("overwrite").parquet(f"{base}/chain/batch={batch_id}")
        stored = spark.read.schema(CHAIN_SCHEMA).parquet(f"{base}/chain/batch={batch_id}")
        seal_segments(stored).write.mode("overwrite").parquet(f"{base}/seals/batch={batch_id}")
        new_heads = last_heads(spark.read.parquet(f"{base}/seals/batch={batch_id}"))
        if heads is not None:  # sources absent from this batch keep their head
            new_heads = heads.join(new_heads.select("source_system"), "source_system", "left_anti").unionByName(new_heads)
        new_heads.write.mode("overwrite").parquet(f"{base}/heads/v={batch_id}")
    return fn


def run_deliveries(spark: SparkSession, deliveries: Sequence[DataFrame], write: Callable[[DataFrame], object], name: str) -> str:
    """Files arrive delivery by delivery; after each, the query is started from its checkpoint, takes what is
    there and stops, so state must survive the restart. ``write`` takes the stream of all files and
    returns its writer; returns the query's folder (``in``, ``ck``)."""
    base = stream_dir(spark, name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for d in deliveries:
            d.write.mode("append").parquet(f"{base}/in")
            run_available(write(read_files(spark, f"{base}/in", "parquet", d.schema)), f"{base}/ck")
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return base


def run_foreach_batch(spark: SparkSession, df: DataFrame, fn: Callable, name: str) -> str:
    base = stream_dir(spark, name)
    run_available(df.writeStream.foreachBatch(fn), f"{base}/ck")
    return base
