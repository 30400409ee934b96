"""Data-quality operators.

``validate`` compiles a whole suite into ONE aggregate over the table (partial
aggregation on every task, one tiny final stage), plus one group-by per column
that needs uniqueness; the per-rule rows are then unpacked from that single
result row. No rule scans the data on its own and nothing is collected.

Semantics (shared with the SQL oracle in ``lakeweave.plans.quality_sql``):
NULLs are ignored by every rule except not-null; ``mostly`` is
``1 - unexpected / element_count >= mostly``; an empty input passes column
rules and is judged by the row-count rule; a rule on a missing column fails.
"""

from __future__ import annotations

import datetime as dt
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from lakeweave.functions.columns import ts_lit
from lakeweave.session import ensure_parallelism, materialize

RESULT_FIELDS = ("suite", "rule_index", "expectation", "column_name", "element_count", "unexpected_count",
                 "observed_value", "success")

COLUMN_MAP = {"expect_column_values_to_not_be_null", "expect_column_values_to_be_unique",
              "expect_column_values_to_match_regex", "expect_column_values_to_be_between",
              "expect_column_values_to_be_in_set", "expect_column_proportion_of_unique_values_to_be_between"}
PAIR = {"expect_column_pair_values_A_to_be_greater_than_B", "expect_column_pair_values_to_be_equal"}


def parse_bound(v, as_datetime: bool):
    if v is None:
        return None
    if as_datetime:
        return dt.datetime.fromisoformat(str(v).replace("Z", "").replace("T", " "))
    return float(v)


def _bound_lit(v) -> Column:
    return ts_lit(v) if isinstance(v, dt.datetime) else F.lit(v)


def _value(df: DataFrame, c: str, as_datetime: bool) -> Column:
    if as_datetime:
        return F.col(c).try_cast("timestamp_ntz")
    if isinstance(df.schema[c].dataType, NumericType):
        return F.col(c).cast("double")
    return F.col(c).try_cast("double")


def row_failure(df: DataFrame, r: dict) -> Column | None:
    """Per-row failure condition of a row-level rule (None if not row-level)."""
    t, kw = r["expectation_type"], r["kwargs"]
    c = kw.get("column")
    if c is not None and c not in df.columns:
        return None
    col = F.col(c) if c else None
    if t == "expect_column_values_to_not_be_null":
        return col.isNull()
    if t == "expect_column_values_to_match_regex":
        return col.isNotNull() & ~col.cast("string").rlike(kw["regex"])
    if t == "expect_column_values_to_be_in_set":
        return col.isNotNull() & ~col.isin(*kw["value_set"])
    if t == "expect_column_values_to_be_between":
        as_dt = bool(kw.get("parse_strings_as_datetimes"))
        v = _value(df, c, as_dt)
        lo, hi = parse_bound(kw.get("min_value"), as_dt), parse_bound(kw.get("max_value"), as_dt)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (v >= _bound_lit(lo))
        if hi is not None:
            ok = ok & (v <= _bound_lit(hi))
        return col.isNotNull() & ~F.coalesce(ok, F.lit(False))
    if t in PAIR:
        a, b = kw["column_A"], kw["column_B"]
        if a not in df.columns or b not in df.columns:
            return None
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        if t == "expect_column_pair_values_to_be_equal":
            return both & ~(F.col(a) == F.col(b))
        ok = (F.col(a) >= F.col(b)) if kw.get("or_equal") else (F.col(a) > F.col(b))
        return both & ~ok
    return None


def _mostly_ok(elem: Column, unexp: Column, mostly: float) -> Column:
    return (elem == 0) | ((F.lit(1.0) - unexp.cast("double") / elem.cast("double")) >= F.lit(float(mostly)))


def validate(df: DataFrame, suite: Sequence[dict], suite_name: str = "suite") -> DataFrame:
    """Q1-Q12: run a suite; one row per rule (see RESULT_FIELDS)."""
    df = ensure_parallelism(df)  # per-row regex / set checks; a no-op on large inputs
    cols = set(df.columns)
    aggs: dict[str, Column] = {"__rows": F.count(F.lit(1))}
    uniq: list[str] = []
    rows: list[Column] = []
    null_l, null_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def out(i, t, cname, elem, unexp, obs, ok):
        return F.struct(F.lit(suite_name).alias("suite"), F.lit(i).alias("rule_index"), F.lit(t).alias("expectation"),
                        F.lit(cname).cast("string").alias("column_name"), elem.cast("bigint").alias("element_count"),
                        unexp.cast("bigint").alias("unexpected_count"), obs.cast("double").alias("observed_value"),
                        ok.alias("success"))

    for i, r in enumerate(suite):
        t, kw = r["expectation_type"], r["kwargs"]
        c = kw.get("column")
        mostly = kw.get("mostly", 1.0)
        if t == "expect_column_to_exist":
            rows.append(out(i, t, c, null_l, null_l, null_d, F.lit(c in cols)))
            continue
        if t == "expect_table_columns_to_match_set":
            need = set(kw["column_set"])
            missing = len(need - cols)
            ok = (need == cols) if kw.get("exact_match") else (missing == 0)
            rows.append(out(i, t, None, null_l, F.lit(missing), null_d, F.lit(ok)))
            continue
        if t == "expect_table_row_count_to_be_between":
            n = F.col("__rows")
            ok = F.lit(True)
            if kw.get("min_value") is not None:
                ok = ok & (n >= kw["min_value"])
            if kw.get("max_value") is not None:
                ok = ok & (n <= kw["max_value"])
            rows.append(out(i, t, None, n, null_l, n, ok))
            continue
        if t in PAIR:
            a, b = kw["column_A"], kw["column_B"]
            label = f"{a},{b}"
            if a not in cols or b not in cols:
                rows.append(out(i, t, label, null_l, null_l, null_d, F.lit(False)))
                continue
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs[f"__e{i}"] = F.count(F.when(both, 1))
            aggs[f"__u{i}"] = F.count(F.when(row_failure(df, r), 1))
            e, u = F.col(f"__e{i}"), F.col(f"__u{i}")
            rows.append(out(i, t, label, e, u, F.when(e > 0, u / e), _mostly_ok(e, u, mostly)))
            continue
        if c not in cols:
            rows.append(out(i, t, c, null_l, null_l, null_d, F.lit(False)))
            continue
        if t == "expect_column_values_to_not_be_null":
            aggs[f"__nn{i}"] = F.count(F.col(c))
            e, u = F.col("__rows"), F.col("__rows") - F.col(f"__nn{i}")
            rows.append(out(i, t, c, e, u, F.when(e > 0, u / e), _mostly_ok(e, u, mostly)))
        elif t in ("expect_column_values_to_be_unique", "expect_column_proportion_of_unique_values_to_be_between"):
            if c not in uniq:
                uniq.append(c)
            k = uniq.index(c)
            e, nd, dup = F.col(f"__un{k}"), F.col(f"__ud{k}"), F.col(f"__dup{k}")
            if t == "expect_column_values_to_be_unique":
                rows.append(out(i, t, c, e, dup, F.when(e > 0, dup / e), _mostly_ok(e, dup, mostly)))
            else:
                p = F.when(e > 0, nd / e)
                ok = F.lit(True)
                if kw.get("min_value") is not None:
                    ok = ok & (p >= kw["min_value"])
                if kw.get("max_value") is not None:
                    ok = ok & (p <= kw["max_value"])
                rows.append(out(i, t, c, e, null_l, p, (e == 0) | F.coalesce(ok, F.lit(False))))
        else:
            cond = row_failure(df, r)
            aggs[f"__e{i}"] = F.count(F.col(c))
            aggs[f"__u{i}"] = F.count(F.when(cond, 1))
            e, u = F.col(f"__e{i}"), F.col(f"__u{i}")
            rows.append(out(i, t, c, e, u, F.when(e > 0, u / e), _mostly_ok(e, u, mostly)))

    # All counters are one aggregate without keys: a row per task is shuffled. Uniqueness shuffles
    # the values of its column alone, combined per task.
    stats = df.agg(*[e.alias(n) for n, e in aggs.items()])
    for k, c in enumerate(uniq):
        per_value = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
        u = per_value.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias(f"__un{k}"),
                          F.count(F.lit(1)).alias(f"__ud{k}"),
                          F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias(f"__dup{k}"))
        stats = stats.crossJoin(u)  # one row x one row
    return stats.select(F.explode(F.array(*rows)).alias("__r")).select("__r.*")


def suite_success(results: DataFrame) -> DataFrame:
    return results.groupBy("suite").agg(F.bool_and("success").alias("success"))


def split_quarantine(df: DataFrame, suite: Sequence[dict], unique_keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Tag every row with the names of the row-level rules it breaks;
    rows with no failure are good, the others go to quarantine with their
    reasons. Duplicate keys are found with a per-key count joined back (the
    counted side has one row per key, so a hot key does not blow up)."""
    conds = []
    for i, r in enumerate(suite):
        f = row_failure(df, r)
        if f is not None:
            label = f"{i}:{r['expectation_type'].replace('expect_', '')}:{r['kwargs'].get('column', '')}"
            conds.append(F.when(F.coalesce(f, F.lit(False)), F.lit(label)))
    out = df
    for k in unique_keys:
        dup = df.groupBy(k).agg(F.count(F.lit(1)).alias(f"__cnt_{k}"))
        out = out.join(dup, k, "left")
        conds.append(F.when(F.col(f"__cnt_{k}") > 1, F.lit(f"duplicate:{k}")))
    reasons = F.array_compact(F.array(*conds)) if conds else F.array().cast("array<string>")
    tagged = out.withColumn("fail_reasons", reasons).drop(*[f"__cnt_{k}" for k in unique_keys])
    good = tagged.filter(F.size("fail_reasons") == 0).drop("fail_reasons")
    bad = tagged.filter(F.size("fail_reasons") > 0)
    return good, bad


def freshness(df: DataFrame, loaded_at: str, now: str | dt.datetime, warn_hours: float = 6,
              error_hours: float = 24, source: str = "source") -> DataFrame:
    """Q14: age of the newest row -> pass / warn / error."""
    age = F.timestamp_diff("MICROSECOND", F.max(loaded_at), ts_lit(now)) / 3.6e9
    r = df.agg(F.max(loaded_at).alias("max_loaded_at"), age.alias("age_hours"))
    status = (F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error")
              .when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))
    return r.select(F.lit(source).alias("source"), "max_loaded_at", "age_hours", status.alias("status"))


def checkpoint(assets: Iterable[tuple[str, DataFrame, str, Sequence[dict]]],
               on_failure: dict[str, str]) -> DataFrame:
    """Q15: validate several assets; every rule row carries its asset and the
    action the checkpoint takes for the asset (pass or the layer's policy)."""
    parts = []
    for asset, df, suite_name, suite in assets:
        res = validate(df, suite, suite_name).withColumn("asset", F.lit(asset))
        parts.append(res)
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    policy = F.create_map(*[x for k, v in on_failure.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("asset")
    ok = F.bool_and("success").over(w)  # rule rows per asset: a few dozen
    return allr.withColumn("asset_success", ok) \
               .withColumn("action", F.when(F.col("asset_success"), "pass").otherwise(policy[F.col("suite")]))


def carry_out(assets: Sequence[tuple[str, DataFrame, str, Sequence[dict]]], on_failure: dict[str, str], path: str,
              unique_keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Q15 with its actions done: (``asset``, ``action``, ``input_rows``, ``promoted_rows``, ``quarantined_rows``), counted in what was written.

    Assets are taken in the order given. One that passes is promoted to ``path/main/<asset>`` as its next version; on
    "quarantine" its good rows are promoted and the others written to ``path/quarantine/<asset>`` with their reasons; any other
    action blocks it. "fail_pipeline" also ends the run: later assets are "not_run" and untouched."""
    from lakeweave.operators.tables import promote

    spark, out, stopped = assets[0][1].sparkSession, [], False
    for asset, df, suite_name, suite in assets:
        if stopped:
            out.append((asset, "not_run", None, None, None))
            continue
        df = materialize(df, f"asset-{asset}")
        passed = validate(df, suite, suite_name).agg(F.bool_and("success")).first()[0]
        action = "pass" if passed else on_failure[suite_name]
        promoted = quarantined = 0
        if action in ("pass", "quarantine"):
            good, bad = (df, None) if passed else split_quarantine(df, suite, (unique_keys or {}).get(asset, ()))
            promoted = spark.read.schema(good.schema).parquet(promote(good, f"{path}/main/{asset}")).count()
            if bad is not None:
                bad.write.mode("append").parquet(f"{path}/quarantine/{asset}")
                quarantined = spark.read.schema(bad.schema).parquet(f"{path}/quarantine/{asset}").count()
        stopped = action == "fail_pipeline"
        out.append((asset, action, df.count(), promoted, quarantined))
    return spark.createDataFrame(out, "asset string, action string, input_rows long, promoted_rows long, quarantined_rows long")


def table_tests(tables: dict[str, DataFrame], tests: dict[str, dict[str, list]]) -> DataFrame:
    """Q12: the tests of many tables: (``table_name``, ``column_name``, ``test``, ``failures``, ``status``, ``table_rows``).

    ``tests``: table -> column -> "not_null" (fails: rows), "unique" (values that occur more than once) or a list of
    accepted values (other values that occur). All row tests and counts of a table are one scan without
    grouping; a unique test or list of values shuffles that column's distinct values alone."""
    out = None
    for name, df in tables.items():
        checks = [(c, t) for c, ts in tests[name].items() for t in ts]
        nulls = [c for c, t in checks if t == "not_null"]
        once = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in nulls])
        for c, t in checks:
            if t == "unique":
                twice = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
                once = once.crossJoin(twice.agg(F.count(F.lit(1)).alias(f"unique_{c}")))  # one row each
            elif t != "not_null":
                other = df.filter(~F.col(c).isin(t)).select(c).distinct()
                once = once.crossJoin(other.agg(F.count(F.lit(1)).alias(f"values_{c}")))
        kind = lambda t: t if isinstance(t, str) else "accepted_values"
        field = lambda c, t: {"not_null": "null", "unique": "unique"}.get(t if isinstance(t, str) else "", "values") + f"_{c}"
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(kind(t)).alias("test"),
                                            F.col(field(c, t)).alias("failures"), F.col("n").alias("table_rows")) for c, t in checks]))
        part = once.select(rows.alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out.select("table_name", "column_name", "test", "failures", F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"), "table_rows")


def quality_summary(results: DataFrame, keys: Sequence[str] = ("suite",)) -> DataFrame:
    """Evaluated / successful / unsuccessful rules and pass rate."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count(F.when(F.col("success"), 1)).alias("successful"),
        F.count(F.when(~F.col("success"), 1)).alias("unsuccessful"),
        (F.count(F.when(F.col("success"), 1)) / F.count(F.lit(1))).alias("pass_rate"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One aggregate pass: nulls, null %, distinct (approximate by
    default, exact on request), min / max as text, mean of numeric columns."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        numeric = isinstance(df.schema[c].dataType, NumericType)
        aggs += [F.count(F.col(c)).alias(f"__nn{i}"),
                 (F.countDistinct(c) if exact else F.approx_count_distinct(c)).alias(f"__d{i}"),
                 F.min(c).cast("string").alias(f"__min{i}"), F.max(c).cast("string").alias(f"__max{i}"),
                 (F.avg(F.col(c).cast("double")) if numeric else F.lit(None).cast("double")).alias(f"__mean{i}")]
    st = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"),
                     (F.col("__rows") - F.col(f"__nn{i}")).alias("null_count"),
                     F.when(F.col("__rows") > 0, (F.col("__rows") - F.col(f"__nn{i}")) / F.col("__rows"))
                      .alias("null_fraction"),
                     F.col(f"__d{i}").cast("bigint").alias("distinct_count"),
                     F.col(f"__min{i}").alias("min_value"), F.col(f"__max{i}").alias("max_value"),
                     F.col(f"__mean{i}").alias("mean_value"))
            for i, c in enumerate(columns)]
    return st.select(F.col("__rows").alias("row_count"), F.explode(F.array(*rows)).alias("__p")) \
             .select("__p.*", "row_count")


def sample_rows(df: DataFrame, n: int = 100, key: str | None = None) -> DataFrame:
    """K4: a deterministic sample: the n rows with the smallest md5 of the key."""
    k = F.col(key) if key else F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.orderBy(F.md5(k.cast("string")), *([key] if key else [])).limit(n)


# Personal-data and secret patterns of the PII scanner
# (Java and RE2 dialects agree on all of them).
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}",
    "phone": r"\+[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "secret": r"(?i)(api[_-]?key|secret|password|token)\s*[=:]\s*\"?[A-Za-z0-9]{16,}",
}


def pii_scan(df: DataFrame, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Q16: per row, the number of matches of every pattern and a flag."""
    patterns = patterns or PII_PATTERNS
    t = F.col(text_col)
    counts = [F.regexp_count(t, F.lit(p)).alias(f"{k}_count") for k, p in patterns.items()]
    out = ensure_parallelism(df).select("*", *counts)
    flag = None
    for k in patterns:
        c = F.col(f"{k}_count") > 0
        flag = c if flag is None else flag | c
    return out.withColumn("has_pii", F.coalesce(flag, F.lit(False)))  # no text holds nothing


def quarantine_pii(df: DataFrame, text_col: str, patterns: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q16 quarantine: (clean rows, rows with personal data or secrets plus
    the names of the patterns that matched)."""
    patterns = patterns or PII_PATTERNS
    scanned = pii_scan(df, text_col, patterns)
    found = F.array_compact(F.array(*[F.when(F.col(f"{k}_count") > 0, F.lit(k)) for k in patterns]))
    tagged = scanned.withColumn("pii_found", found).drop(*[f"{k}_count" for k in patterns])
    return (tagged.filter(~F.col("has_pii")).drop("has_pii", "pii_found"),
            tagged.filter(F.col("has_pii")).drop("has_pii"))


# Column-name patterns of personal data classes.
PII_NAME_PATTERNS = {
    "PII_HIGH": r"(?i)(ssn|social_security|passport|card|iban|date_of_birth|dob)",
    "PII_MEDIUM": r"(?i)(email|phone|address|ip_address|source_ip)",
    "PII_LOW": r"(?i)(first_name|last_name|full_name|username|postal_code|city)",
}


def tag_pii_columns(df: DataFrame, min_rate: float = 0.05, patterns: dict[str, str] | None = None) -> DataFrame:
    """Q18: tag columns as personal data by name and by content. The content
    scan is one aggregate: match rate of every pattern on every string column."""
    import re
    patterns = patterns or PII_PATTERNS
    spark = df.sparkSession
    by_name = []
    for c in df.columns:
        for tag, rx in PII_NAME_PATTERNS.items():
            if re.search(rx.replace("(?i)", ""), c, flags=re.IGNORECASE):
                by_name.append((c, tag, "name"))
                break
    name_df = spark.createDataFrame(by_name, "column_name string, tag string, source string")
    strings = [c for c in df.columns if isinstance(df.schema[c].dataType, StringType)]
    if not strings:
        return name_df.withColumn("match_rate", F.lit(None).cast("double"))
    aggs = [F.avg(F.when(F.col(c).rlike(p), 1.0).otherwise(0.0)).alias(f"{c}__{k}")
            for c in strings for k, p in patterns.items()]
    rates = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pattern"), F.col(f"{c}__{k}").alias("match_rate"))
             for c in strings for k in patterns]
    content = (rates.select(F.explode(F.array(*items)).alias("x")).select("x.*")
               .filter(F.col("match_rate") >= min_rate)
               .select("column_name", F.upper(F.concat(F.lit("PII_"), F.col("pattern"))).alias("tag"),
                       F.lit("content").alias("source"), "match_rate"))
    return name_df.withColumn("match_rate", F.lit(None).cast("double")).unionByName(content)


def schema_frame(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string, ordinal int")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q19: added / dropped / retyped columns between two versions."""
    a = schema_frame(old).select("column_name", F.col("data_type").alias("old_type"))
    b = schema_frame(new).select("column_name", F.col("data_type").alias("new_type"))
    j = a.join(b, "column_name", "full_outer")
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped")
              .when(F.col("old_type") != F.col("new_type"), "retyped"))
    return j.withColumn("change", change).filter(F.col("change").isNotNull())


def consecutive_failures(runs: DataFrame, n: int = 3, threshold: float = 0.95, key: str = "suite",
                         order: str = "run_ts", rate: str = "pass_rate") -> DataFrame:
    """Flag runs that close a streak of n consecutive runs below the
    threshold (a full frame of n runs is required)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return runs.withColumn("alert", (F.count(F.lit(1)).over(w) == n) & (F.max(rate).over(w) < threshold))
