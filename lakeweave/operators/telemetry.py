"""Log and metric analytics in batch form.

Rolling PromQL-style windows are computed the scalable way: events are first
reduced to fixed time buckets per series (a hash aggregate with map-side
combine), and the rolling windows then run over the bucket series, whose
length is bounded by the time range, not by the number of events. Sliding
``window()`` expansion (one copy of every row per window) is avoided.
"""

from __future__ import annotations

import sys
from typing import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeweave.functions.columns import bucket_number, epoch_micros, from_epoch_micros, seconds_between, ts_lit

# ---------------------------------------------------------------------------
# Logs (M1-M4)
# ---------------------------------------------------------------------------

JSON_LOG_SCHEMA = StructType([StructField(n, StringType()) for n in
                              ("timestamp", "level", "logger", "thread", "message", "event_type")])
# Services whose logs are JSON, and the plain-text line layout
# "timestamp level [thread] logger message".
JSON_SERVICES = r"^(trino.*|keycloak|elasticsearch|openmetadata.*|airflow.*)$"
TEXT_LINE_RE = r"^(\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2},\d+)\s+(\w+)\s+\[([^\]]+)\]\s+(\S+)\s+-\s+(.*)$"


def drop_noise(lines: DataFrame, body: str = "body", scrape_path: str = "/metrics/prometheus",
               service: str = "service", scraped_services: str = r"^trino.*$") -> DataFrame:
    """M2: drop blank lines, and metric-scrape lines of the services that log
    their scrapes. Lines without a service are kept."""
    scrape = F.coalesce(F.col(service).rlike(scraped_services), F.lit(False)) & F.col(body).contains(scrape_path)
    return lines.filter(~F.col(body).rlike(r"^\s*$") & ~scrape)


def json_time(text: Column) -> Column:
    """RFC 3339 stamp, with any number of fraction digits, as NTZ in UTC; a stamp without
    an offset is taken as it is. Neither depends on the session's zone."""
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    return (F.when(zoned, from_epoch_micros(F.unix_micros(F.try_to_timestamp(text))))
            .otherwise(text.try_cast("timestamp_ntz")))


def parse_logs(lines: DataFrame, body: str = "body", service: str = "service",
               json_services: str = JSON_SERVICES) -> DataFrame:
    """M1 + M3: JSON bodies for the services that match a pattern, regex for the
    others; typed timestamp, level / logger / thread labels and the event_type attribute."""
    is_json = F.coalesce(F.col(service).rlike(json_services), F.lit(False))
    j = F.from_json(F.col(body), JSON_LOG_SCHEMA)
    pick = lambda jf, idx: F.when(is_json, j[jf]).otherwise(
        F.nullif(F.regexp_extract(F.col(body), TEXT_LINE_RE, idx), F.lit("")))
    ts_text = pick("timestamp", 1)
    return lines.select(
        "*",
        F.when(is_json, json_time(ts_text))
         .otherwise(F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd HH:mm:ss,SSS")).cast("timestamp_ntz")).alias("log_ts"),
        pick("level", 2).alias("level"),
        pick("thread", 3).alias("thread"),
        pick("logger", 4).alias("logger"),
        pick("message", 5).alias("message"),
        F.when(is_json, F.get_json_object(F.col(body), "$.event_type")).alias("event_type"),
        F.when(is_json, F.lit("json")).otherwise(F.lit("text")).alias("format"),
    )


OBJECT_STORE_SERVICES = r"^minio.*$"


def parse_fields(lines: DataFrame, body: str = "body", service: str = "service", json_services: str = JSON_SERVICES,
                 object_stores: str = OBJECT_STORE_SERVICES) -> DataFrame:
    """M1, the other stages: ``class`` of JSON logs, and for object stores ``level``, ``message``, ``api``, ``bucket`` and ``object``
    of the request. Fields of other services and of lines that are no JSON are null; no line is dropped."""
    store, is_json = (F.coalesce(F.col(service).rlike(p), F.lit(False)) for p in (object_stores, json_services))
    j = F.from_json(F.col(body), "level string, message string, class string, api struct<name:string,bucket:string,object:string>")
    rows = lines.select("*", F.explode(F.array(j)).alias("_j"))  # parsed once
    of = {"level": "level", "message": "message", "api": "api.name", "bucket": "api.bucket", "object": "api.object"}
    return rows.select(*lines.columns, F.when(is_json, F.col("_j.class")).alias("class"),
                       *[F.when(store, F.col(f"_j.{path}")).alias(name) for name, path in of.items()])


def log_search(parsed: DataFrame, service: str | None, contains: str | None, line_format: str,
               fields: Sequence[str]) -> DataFrame:
    """M4: label match, substring filter, then a formatted line."""
    df = parsed
    if service is not None:
        df = df.filter(F.col("service") == service)
    if contains is not None:
        df = df.filter(F.col("body").contains(contains))
    return df.select("line_id", F.format_string(line_format, *[F.col(f) for f in fields]).alias("line"))


# ---------------------------------------------------------------------------
# Buckets, rates, ratios
# ---------------------------------------------------------------------------

def bucket_id(ts: str | Column, seconds: int) -> Column:
    return bucket_number(ts, seconds)


def bucket_start(bid: Column, seconds: int) -> Column:
    return from_epoch_micros(bid * F.lit(seconds * 1_000_000))


def bucketize(samples: DataFrame, keys: Sequence[str], seconds: int = 300, ts: str = "ts",
              failed: str = "failed") -> DataFrame:
    """Per series and bucket: requests and failures (partial aggregation)."""
    return (samples.groupBy(*keys, bucket_id(ts, seconds).alias("bucket"))
                   .agg(F.count(F.lit(1)).alias("requests"),
                        F.count(F.when(F.col(failed), 1)).alias("failures")))


def rate(samples: DataFrame, keys: Sequence[str], minutes: int = 5, ts: str = "ts") -> DataFrame:
    """M5: events per second in tumbling windows of N minutes."""
    sec = minutes * 60
    b = samples.groupBy(*keys, bucket_id(ts, sec).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return b.select(*keys, bucket_start(F.col("bucket"), sec).alias("window_start"), "events",
                    (F.col("events") / F.lit(float(sec))).alias("per_second"))


def counter_rate(samples: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """M5 for monotonic counters: per-second increase between scrapes; a drop
    means the counter was reset, so the increase is the new value."""
    w = Window.partitionBy(*keys).orderBy(ts)
    prev_v, prev_t = F.lag(value).over(w), F.lag(ts).over(w)
    inc = (F.when(prev_v.isNull(), F.lit(None))  # first scrape of a series: no rate yet
           .when(F.col(value) >= prev_v, F.col(value) - prev_v).otherwise(F.col(value)))
    return samples.select("*", inc.alias("increase"),
                          (inc / seconds_between(F.col(ts), prev_t)).alias("per_second")).filter(F.col("increase").isNotNull())


def rolling_ratio(buckets: DataFrame, keys: Sequence[str], window_buckets: int) -> DataFrame:
    """M6: success ratio over the last N buckets at each bucket (range frame
    on the bucket number, so empty buckets are honoured)."""
    w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(window_buckets - 1), 0)
    req, fail = F.sum("requests").over(w), F.sum("failures").over(w)
    return buckets.select(*keys, "bucket", req.alias("requests"), fail.alias("failures"),
                          ((req - fail) / req).alias("success_ratio"))


def success_ratios(samples: DataFrame, keys: Sequence[str], bucket_seconds: int = 300,
                   windows: dict[str, int] | None = None) -> DataFrame:
    """M6: success ratio over 5 m / 1 h / 6 h, evaluated at every 5-minute
    bucket (one window operator: same partitioning and order, three frames)."""
    windows = windows or {"5m": 1, "1h": 12, "6h": 72}
    b = bucketize(samples, keys, bucket_seconds)
    cols = []
    for name, n in windows.items():
        w = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-(n - 1), 0)
        req = F.sum("requests").over(w)
        cols.append(((req - F.sum("failures").over(w)) / req).alias(f"ratio_{name}"))
    return b.select(*keys, "bucket", *cols, bucket_start(F.col("bucket") + 1, bucket_seconds).alias("bucket_end"))


def burn_rate_alerts(samples: DataFrame, keys: Sequence[str], slo: float = 0.995, bucket_seconds: int = 300,
                     critical: float = 14.4, warning: float = 6.0) -> DataFrame:
    """M7: error-budget burn rate (1 - ratio) / (1 - SLO) over 1 h and 6 h;
    critical when both exceed 14.4, warning when both exceed 6."""
    budget = 1.0 - slo
    b = bucketize(samples, keys, bucket_seconds)
    w1 = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-11, 0)
    w6 = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-71, 0)
    r = b.select(*keys, "bucket",
                 ((F.sum("failures").over(w1) / F.sum("requests").over(w1)) / budget).alias("burn_1h"),
                 ((F.sum("failures").over(w6) / F.sum("requests").over(w6)) / budget).alias("burn_6h"))
    sev = (F.when((F.col("burn_1h") > critical) & (F.col("burn_6h") > critical), "critical")
           .when((F.col("burn_1h") > warning) & (F.col("burn_6h") > warning), "warning"))
    return r.withColumn("severity", sev).withColumn("bucket_end", bucket_start(F.col("bucket") + 1, bucket_seconds))


def budget_remaining(samples: DataFrame, keys: Sequence[str], slo: float = 0.995, days: int = 28) -> DataFrame:
    """28-day average of the daily success ratio and the error budget
    left, at every day (range frame over the day number)."""
    day = bucket_number("ts", 86_400)
    d = samples.groupBy(*keys, day.alias("day_no")).agg(
        ((F.count(F.lit(1)) - F.count(F.when(F.col("failed"), 1))) / F.count(F.lit(1))).alias("ratio"))
    w = Window.partitionBy(*keys).orderBy("day_no").rangeBetween(-(days - 1), 0)
    avg = F.avg("ratio").over(w)
    return d.select(*keys, F.date_from_unix_date(F.col("day_no").cast("int")).alias("day"),
                    avg.alias("avg_ratio_28d"), (1 - (1 - avg) / (1 - slo)).alias("budget_remaining"))


# ---------------------------------------------------------------------------
# Latency histograms (M8)
# ---------------------------------------------------------------------------

DEFAULT_LE = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 60.0)


def histogram(samples: DataFrame, keys: Sequence[str], value: str, le: Sequence[float] = DEFAULT_LE,
              bucket_seconds: int | None = None, ts: str = "ts") -> DataFrame:
    """Cumulative histogram buckets (le ..., +Inf) per series, one pass."""
    g = list(keys) + ([bucket_id(ts, bucket_seconds).alias("bucket")] if bucket_seconds else [])
    aggs = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{i}") for i, b in enumerate(le)]
    h = samples.groupBy(*g).agg(*aggs, F.count(F.lit(1)).alias("le_inf"))
    return h.withColumn("cum", F.array(*[F.col(f"le_{i}") for i in range(len(le))], F.col("le_inf"))) \
            .drop(*[f"le_{i}" for i in range(len(le))])


def histogram_quantile(q: float, cum: Column, le: Sequence[float] = DEFAULT_LE) -> Column:
    """M8: quantile from cumulative bucket counts with linear interpolation
    inside the bucket; a rank in the +Inf bucket returns the last finite bound."""
    bounds = F.array(*[F.lit(float(b)) for b in le])
    total = F.element_at(cum, -1)
    rank = F.lit(q) * total
    idx = F.array_position(F.transform(cum, lambda c: c >= rank), True)  # 1-based bucket
    n = len(le)
    upper = F.element_at(bounds, F.least(idx, F.lit(n)).cast("int"))
    lower = F.when(idx > 1, F.element_at(bounds, (idx - 1).cast("int"))).otherwise(F.lit(0.0))
    c_hi = F.element_at(cum, idx.cast("int"))
    c_lo = F.when(idx > 1, F.element_at(cum, (idx - 1).cast("int"))).otherwise(F.lit(0))
    interp = lower + (upper - lower) * (rank - c_lo) / (c_hi - c_lo)
    return F.when(total == 0, F.lit(None).cast("double")).when(idx > n, F.lit(float(le[-1]))).otherwise(interp)


def share_below(cum: Column, le: Sequence[float], bound: float) -> Column:
    """M8: share of requests at or under a bucket bound (e.g. 60 s)."""
    i = list(le).index(bound) + 1
    return F.element_at(cum, i) / F.element_at(cum, -1)


def latency_percentiles(samples: DataFrame, keys: Sequence[str], value: str,
                        qs: Sequence[float] = (0.5, 0.95, 0.99), exact: bool = False) -> DataFrame:
    """M8 on raw values: percentiles per series. The default is
    ``percentile_approx`` (bounded memory per group, mergeable partials);
    ``exact=True`` holds one count per distinct value of a group, so use it
    only for bounded-domain values."""
    cols = []
    for q in qs:
        name = f"p{int(round(q * 100))}"
        e = F.percentile(F.col(value), q) if exact else F.percentile_approx(value, q, 10000).cast("double")
        cols.append(e.alias(name))
    return samples.groupBy(*keys).agg(*cols)


# ---------------------------------------------------------------------------
# Alerts (M9, M10, W4, J8)
# ---------------------------------------------------------------------------

def sustained(series: DataFrame, keys: Sequence[str], cond: Column, bucket_seconds: int, for_minutes: int,
              bucket: str = "bucket") -> DataFrame:
    """W4 gaps-and-islands: runs of consecutive buckets where ``cond`` holds,
    kept when they last at least ``for_minutes``. Runs over bucket series."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    s = series.filter(cond).select(*keys, bucket)
    s = s.withColumn("__island", F.col(bucket) - F.row_number().over(w))
    isl = s.groupBy(*keys, "__island").agg(F.min(bucket).alias("first_bucket"), F.max(bucket).alias("last_bucket"))
    dur = (F.col("last_bucket") - F.col("first_bucket") + 1) * F.lit(bucket_seconds / 60.0)
    return (isl.withColumn("minutes", dur).filter(F.col("minutes") >= for_minutes)
               .select(*keys, bucket_start(F.col("first_bucket"), bucket_seconds).alias("starts_at"),
                       bucket_start(F.col("last_bucket") + 1, bucket_seconds).alias("ends_at"), "minutes")
               .withColumn("fires_at", F.col("starts_at") + F.make_interval(mins=F.lit(for_minutes))))


# The library's own default rules over 5-minute gauges of the derived metrics:
# (alert, gauge, operator, threshold, for minutes, severity).
ALERT_RULES = [
    ("HighFailureRatio", "failure_ratio", ">", 0.5, 10, "critical"),
    ("ElevatedFailureRatio", "failure_ratio", ">", 0.25, 5, "warning"),
    ("HighLatency", "max_latency_s", ">", 45.0, 10, "warning"),
    ("LowTraffic", "requests", "<", 2.0, 30, "warning"),
]


def gauges(samples: DataFrame, keys: Sequence[str], bucket_seconds: int = 300) -> DataFrame:
    return samples.groupBy(*keys, bucket_id("ts", bucket_seconds).alias("bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("requests"),
        (F.count(F.when(F.col("failed"), 1)) / F.count(F.lit(1))).alias("failure_ratio"),
        F.max("latency_s").alias("max_latency_s"))


def threshold_alerts(samples: DataFrame, keys: Sequence[str], rules: Sequence[tuple] = ALERT_RULES,
                     bucket_seconds: int = 300) -> DataFrame:
    """M9: every rule over the gauge series, firing after its 'for' duration. The rules are an array beside
    each gauge row, of which those that hold are taken apart: one scan and one window for all rules."""
    g = gauges(samples, keys, bucket_seconds)
    test = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b}
    return sustained_rules(g, keys, [(name, test[op](F.col(gauge), F.lit(thr)), for_min, sev) for name, gauge, op, thr, for_min, sev in rules],
                           bucket_seconds)


def sustained_rules(series: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column, int, str]],
                    bucket_seconds: int = 300) -> DataFrame:
    """Alerts of rules (name, condition, for minutes, severity) over a bucket series: runs of consecutive buckets in which the
    condition holds, of at least that length."""
    held = F.array_compact(F.array(*[F.when(cond, F.struct(
        F.lit(name).alias("alertname"), F.lit(sev).alias("severity"), F.lit(for_min).cast("int").alias("for_minutes")))
        for name, cond, for_min, sev in rules]))
    rows = series.select(*keys, "bucket", F.explode(held).alias("_rule")).select(*keys, "bucket", "_rule.*")
    island = ["alertname", "severity", "for_minutes", *keys]
    w = Window.partitionBy(*island).orderBy("bucket")
    runs = (rows.withColumn("_island", F.col("bucket") - F.row_number().over(w)).groupBy(*island, "_island")
            .agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last")))
    runs = runs.filter((F.col("_last") - F.col("_first") + 1) * F.lit(bucket_seconds / 60.0) >= F.col("for_minutes"))
    start = bucket_start(F.col("_first"), bucket_seconds)
    return runs.select("alertname", *keys, "severity", start.alias("starts_at"), bucket_start(F.col("_last") + 1, bucket_seconds).alias("ends_at"),
                       (start + F.make_interval(mins=F.col("for_minutes"))).alias("fires_at"))


# Burn-rate alerts (alert, burn over 1 h and 6 h above, for minutes, severity).
BURN_ALERTS = [("CriticalErrorBudgetBurn", 14.4, 2, "critical"), ("WarningErrorBudgetBurn", 6.0, 15, "warning")]


def burn_rate_firing(samples: DataFrame, keys: Sequence[str], slo: float = 0.995, bucket_seconds: int = 300) -> DataFrame:
    """M7 with hold times: when a burn-rate alert starts, fires (after it has held long enough) and ends."""
    r = burn_rate_alerts(samples, keys, slo, bucket_seconds)
    return sustained_rules(r, keys, [(name, (F.col("burn_1h") > x) & (F.col("burn_6h") > x), m, sev) for name, x, m, sev in BURN_ALERTS], bucket_seconds)


def inhibit(alerts: DataFrame, equal: Sequence[str] = ("job", "instance")) -> DataFrame:
    """Drop warnings while a critical alert is active for the same labels
    (anti join on the labels with an interval-overlap condition)."""
    crit = alerts.filter(F.col("severity") == "critical").select(
        *[F.col(c).alias(f"__c_{c}") for c in equal], F.col("fires_at").alias("__c_from"),
        F.col("ends_at").alias("__c_to"))
    cond = (F.col("severity") == "warning") & (F.col("fires_at") < F.col("__c_to")) & (F.col("ends_at") > F.col("__c_from"))
    for c in equal:
        cond = cond & (F.col(c) == F.col(f"__c_{c}"))
    return alerts.join(crit, cond, "left_anti")


# Routing tree (receiver and repeat interval per severity).
ROUTES = {"critical": ("slack-critical", 60), "warning": ("dev-null", 720)}
DEFAULT_ROUTE = ("dev-null", 240)


def group_notifications(alerts: DataFrame, group_by: Sequence[str] = ("alertname", "job")) -> DataFrame:
    """Alerts grouped by (alertname, job); a new notification starts when
    an alert fires later than the route's repeat interval after the previous
    one (session-style gap); routed by severity."""
    recv = F.when(F.col("severity") == "critical", ROUTES["critical"][0]) \
            .when(F.col("severity") == "warning", ROUTES["warning"][0]).otherwise(DEFAULT_ROUTE[0])
    rep = F.when(F.col("severity") == "critical", ROUTES["critical"][1]) \
           .when(F.col("severity") == "warning", ROUTES["warning"][1]).otherwise(DEFAULT_ROUTE[1])
    a = alerts.withColumn("receiver", recv).withColumn("repeat_minutes", rep)
    w = Window.partitionBy(*group_by, "receiver").orderBy("fires_at", "starts_at")
    gap = seconds_between(F.col("fires_at"), F.lag("fires_at").over(w)) / 60
    a = a.withColumn("__new", F.when(gap.isNull() | (gap > F.col("repeat_minutes")), 1).otherwise(0))
    a = a.withColumn("notification_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return a.groupBy(*group_by, "receiver", "notification_no").agg(
        F.min("fires_at").alias("sent_at"), F.count(F.lit(1)).alias("alerts"))


# Fixed values of the route tree, by severity: receiver, group wait, group interval, repeat interval (seconds).
NOTIFY = {"critical": ("slack-critical", 10, 300, 3600), "warning": ("dev-null", 120, 300, 43200)}
NOTIFY_DEFAULT = ("dev-null", 30, 300, 14400)


def _automaton(group):
    """Notifications of one episode: after the wait, and then at whole intervals when there is a new alert or
    the last one sent is a repeat interval old. Steps from one such time to the next, not from tick to tick."""
    import numpy as np
    import pyarrow as pa

    g = group.sort_by("fires_us")
    fires, ends = (np.asarray(g.column(c)) for c in ("fires_us", "ends_us"))
    wait, interval, repeat = (int(g.column(c)[0].as_py()) * 1_000_000 for c in ("wait", "every", "repeat"))
    start, over = int(fires[0]) + wait, int(ends.max())
    tick, before, last, out = start, int(fires[0]) - 1, None, []
    while tick < over:
        active = (fires <= tick) & (ends > tick)
        new = int((active & (fires > before)).sum())
        if new or tick - last >= repeat:  # an episode always has an active alert, so the first step sends
            out.append((tick, "new" if new else "repeat", int(active.sum()), new))
            last = tick
        before = tick
        later = fires[fires > tick]
        at = min(last + repeat, int(later[0]) if len(later) else over)
        tick = start + -(-(at - start) // interval) * interval
    return pa.table({"episode": pa.array([g.column("episode")[0].as_py()] * len(out), pa.string()),
                     "sent_us": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.string()),
                     "active": pa.array([r[2] for r in out], pa.int64()), "new_alerts": pa.array([r[3] for r in out], pa.int64())})


def notifications(alerts: DataFrame, group_by: Sequence[str] = ("alertname", "job"), slice_seconds: int = 86400) -> DataFrame:
    """What is sent for alerts that are active from ``fires_at`` to ``ends_at``, by group and route: columns of the
    group, ``receiver``, ``sent_at``, ``kind`` (new, repeat), ``active`` and ``new_alerts``.

    A group starts anew once all its alerts have ended, so it is cut there into episodes, each worked
    off on its own; gaps are found over slices of time (a running end within a slice, and over one row a slice),
    so no window holds all alerts of a group. Alerts without a time or of no duration send nothing."""
    sev = F.col("severity")
    route = lambda i: F.when(sev == "critical", NOTIFY["critical"][i]).when(sev == "warning", NOTIFY["warning"][i]).otherwise(NOTIFY_DEFAULT[i])
    keys = [*group_by, "receiver", "wait", "every", "repeat"]
    a = alerts.select(*group_by, route(0).alias("receiver"), route(1).alias("wait"), route(2).alias("every"), route(3).alias("repeat"),
                      epoch_micros("fires_at").alias("fires_us"), epoch_micros("ends_at").alias("ends_us")).filter("ends_us > fires_us")
    a = a.withColumn("_slice", F.floor(F.col("fires_us") / F.lit(slice_seconds * 1_000_000)))
    slices = a.groupBy(*keys, "_slice").agg(F.max("ends_us").alias("_end"))
    carried = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_s"), F.max("_end").over(carried).alias("_carry"))
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    a = a.join(slices, same)
    inside = Window.partitionBy(*keys, "_slice").orderBy("fires_us", "ends_us")
    open_until = F.greatest(F.max("ends_us").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    a = a.withColumn("_new", open_until.isNull() | (F.col("fires_us") >= open_until))
    starts = a.filter("_new").groupBy(*keys, "_slice").agg(F.max("fires_us").alias("_start"))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_slice").alias("_s"),
                           F.max("_start").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    upto = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_s")
    spans = starts.select("*", F.lead("_s").over(upto).alias("_next"))
    # the last start at or before an alert: in its own slice, or in the last earlier slice that has one
    own = F.max(F.when(F.col("_new"), F.col("fires_us"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("_own", own).drop("_s", "_carry", *[f"_{k}" for k in keys])
    earlier = (F.col("_s") < F.col("_slice")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("_slice")))
    for k in keys:
        earlier = earlier & F.col(k).eqNullSafe(F.col(f"_{k}"))
    a = a.join(spans, earlier, "left").withColumn("_start", F.coalesce("_own", "_upto"))
    named = a.select(*keys, "fires_us", "ends_us", F.col("_start"), F.sha2(F.to_json(F.struct(*keys, "_start")), 256).alias("episode"))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy
    sent = named.select("episode", "fires_us", "ends_us", "wait", "every", "repeat").groupBy("episode").applyInArrow(
        _automaton, "episode string, sent_us long, kind string, active long, new_alerts long")
    of = named.select("episode", *group_by, "receiver").distinct()
    return of.join(sent, "episode").select(*group_by, "receiver", from_epoch_micros(F.col("sent_us")).alias("sent_at"), "kind", "active", "new_alerts")


# ---------------------------------------------------------------------------
# Freshness, silence, brute force
# ---------------------------------------------------------------------------

def pipeline_freshness(raw_loads: DataFrame, staging_loads: DataFrame, key: str = "table_name",
                       max_hours: float = 4.0, target: float = 0.95) -> DataFrame:
    """Per table, staging loaded within N hours of raw; overall share."""
    j = raw_loads.join(staging_loads, key, "left")
    lag_h = seconds_between(F.col("staging_loaded_at"), F.col("raw_loaded_at")) / 3600
    per = j.withColumn("lag_hours", lag_h).withColumn("met", F.coalesce(lag_h <= max_hours, F.lit(False)))
    return per.agg(F.count(F.lit(1)).alias("tables"), F.avg(F.col("met").cast("double")).alias("share_met")) \
              .withColumn("slo_met", F.col("share_met") >= target)


def silent_sources(events: DataFrame, source: str, ts: str, now: str, max_gap_minutes: int = 10) -> DataFrame:
    """Silences longer than N minutes per source (including the open
    one up to ``now``). Exact: events are reduced to per-minute min/max first,
    and a gap longer than a minute can only lie between two such buckets."""
    m = events.groupBy(source, bucket_id(ts, 60).alias("minute")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    w = Window.partitionBy(source).orderBy("minute")
    nxt = F.coalesce(F.lead("first_ts").over(w), ts_lit(now))
    g = m.select(source, F.col("last_ts").alias("silent_from"), nxt.alias("silent_to"))
    g = g.withColumn("gap_minutes", seconds_between(F.col("silent_to"), F.col("silent_from")) / 60)
    return g.filter(F.col("gap_minutes") > max_gap_minutes)


def brute_force(events: DataFrame, user: str, ts: str, failed: Column, minutes: int = 5,
                threshold: int = 3) -> DataFrame:
    """Users with more than N failed logins in a tumbling window."""
    sec = minutes * 60
    g = events.filter(failed).groupBy(user, bucket_id(ts, sec).alias("bucket")).agg(
        F.count(F.lit(1)).alias("failures"))
    return g.filter(F.col("failures") > threshold).select(
        user, bucket_start(F.col("bucket"), sec).alias("window_start"), "failures")
