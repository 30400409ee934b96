"""Audit operators.

The hash chain (G7, G8, W2) is in ``trail.py``; its functions are importable from here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.functions.columns import seconds_between, since, ts_lit
from lakeweave.operators.trail import (UNKNOWN, broken_links, chain_events, chain_heads, inclusion_proofs, proof_holds,  # noqa: F401
                                       seal_segments, verify_chain, verify_heads, verify_seals)

# How fixture event types map onto the audit event-type
# registry (event type, source system, action type).
EVENT_REGISTRY = [
    ("signup", "auth.login.success", "keycloak", "AUTH"),
    ("error", "data.access.denied", "ranger", "READ"),
    ("click", "data.query.executed", "trino", "READ"),
    ("view", "data.query.executed", "trino", "READ"),
    ("purchase", "pipeline.task.executed", "airflow", "WRITE"),
]

# The reference's event types (audit-trail-specification 1.2) stand for themselves:
# (event type, source system, action type). It names no action types; these are ours.
CANONICAL_TYPES = [
    ("auth.login.success", "keycloak", "AUTH"), ("auth.login.failure", "keycloak", "AUTH"),
    ("auth.logout", "keycloak", "AUTH"), ("auth.token.issued", "keycloak", "AUTH"),
    ("auth.token.refresh", "keycloak", "AUTH"), ("auth.mfa.challenge", "keycloak", "AUTH"),
    ("auth.mfa.success", "keycloak", "AUTH"), ("auth.mfa.failure", "keycloak", "AUTH"),
    ("auth.account.locked", "keycloak", "AUTH"), ("data.query.executed", "trino", "READ"),
    ("data.query.rejected", "ranger", "READ"), ("data.access.allowed", "ranger", "READ"),
    ("data.access.denied", "ranger", "READ"), ("data.column.masked", "ranger", "READ"),
    ("data.row.filtered", "ranger", "READ"), ("secret.read", "openbao", "READ"),
    ("secret.write", "openbao", "WRITE"), ("secret.delete", "openbao", "DELETE"),
    ("secret.lease.created", "openbao", "CREATE"), ("secret.lease.renewed", "openbao", "UPDATE"),
    ("secret.lease.revoked", "openbao", "DELETE"), ("pki.cert.issued", "openbao", "CREATE"),
    ("pki.cert.revoked", "openbao", "DELETE"), ("pipeline.dag.started", "airflow", "WRITE"),
    ("pipeline.dag.completed", "airflow", "WRITE"), ("pipeline.task.executed", "airflow", "WRITE"),
    ("pipeline.task.failed", "airflow", "WRITE"), ("db.query.ddl", "postgresql", "ADMIN"),
    ("db.query.grant", "postgresql", "ADMIN"), ("db.connection.failed", "postgresql", "AUTH"),
    ("storage.object.put", "minio", "WRITE"), ("storage.object.get", "minio", "READ"),
    ("storage.object.delete.attempt", "minio", "DELETE"), ("storage.worm.violation", "minio", "DELETE"),
    ("catalog.table.created", "polaris", "CREATE"), ("catalog.table.dropped", "polaris", "DELETE"),
    ("catalog.schema.created", "polaris", "CREATE"), ("catalog.policy.changed", "ranger", "ADMIN"),
    ("identity.user.created", "keycloak", "CREATE"), ("identity.user.disabled", "keycloak", "UPDATE"),
    ("identity.group.modified", "keycloak", "UPDATE"), ("identity.role.assigned", "keycloak", "ADMIN"),
    ("compliance.erasure.initiated", "airflow", "DELETE"), ("compliance.erasure.completed", "airflow", "DELETE"),
    ("compliance.redaction.applied", "audit-redact-service", "UPDATE"),
]


def registry_frame(spark: SparkSession) -> DataFrame:
    rows = EVENT_REGISTRY + [(t, t, source, action) for t, source, action in CANONICAL_TYPES]
    return spark.createDataFrame(rows, "raw_type string, event_type_canonical string, "
                                       "source_system string, action_type string")


# ---------------------------------------------------------------------------
# Risk flags
# ---------------------------------------------------------------------------

def first_access(audit: DataFrame, user: str = "username", table_col: str = "table_name",
                 ts: str = "timestamp") -> DataFrame:
    """W7 on one row per (access, table): flag the first access of a user to
    a table (ties at the same instant are all first). ``min(ts)`` is a
    fixed-width hash aggregate with map-side combine; the join back is
    skew-tolerant under AQE even when one user issues a third of the queries."""
    firsts = audit.groupBy(user, table_col).agg(F.min(ts).alias("__first"))
    return (audit.join(firsts, [user, table_col], "left")
                 .withColumn("first_time", F.col(ts) == F.col("__first")).drop("__first"))


def first_access_maps(audit: DataFrame, user: str = "username", tables: str = "tables_accessed",
                      ts: str = "timestamp") -> DataFrame:
    """Per user: map table -> first access time. Its size is bounded by the
    number of tables, not by the number of queries."""
    firsts = (audit.select(user, F.explode(tables).alias("__t"), ts)
                   .groupBy(user, "__t").agg(F.min(ts).alias("__first")))
    return firsts.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("__t", "__first"))).alias("__firsts"))


def flag_risk(audit: DataFrame, pii_pattern: str = r"\.customers$") -> DataFrame:
    """Adds risk_level and risk_flags to every audit row.

    CROSS_TENANT_ACCESS and PII_ACCESS are per-row array predicates (no
    shuffle); FIRST_TIME_ACCESS looks the row's tables up in the user's map
    of first accesses (one join on the user). Level: CRITICAL cross-tenant
    PII, HIGH cross-tenant, MEDIUM PII or first time, LOW otherwise.
    PRIVILEGE_ESCALATION has no definition in the reference: left out."""
    tables = F.col("tables_accessed")
    cross = F.exists(tables, lambda t: F.split(t, r"\.").getItem(0) != F.col("tenant_id"))
    pii = F.exists(tables, lambda t: t.rlike(pii_pattern))
    j = audit.join(first_access_maps(audit), "username", "left")
    first = F.exists(tables, lambda t: F.element_at(F.col("__firsts"), t) == F.col("timestamp"))
    fl = F.array_compact(F.array(F.when(cross, F.lit("CROSS_TENANT_ACCESS")),
                                 F.when(first, F.lit("FIRST_TIME_ACCESS")),
                                 F.when(pii, F.lit("PII_ACCESS"))))
    level = (F.when(cross & pii, "CRITICAL").when(cross, "HIGH").when(pii | first, "MEDIUM").otherwise("LOW"))
    return j.withColumn("risk_level", level).withColumn("risk_flags", fl).drop("__firsts")


# ---------------------------------------------------------------------------
# Canonical record
# ---------------------------------------------------------------------------

def normalize_events(audit: DataFrame, registry: DataFrame, cluster_ns: str = "lakehouse") -> DataFrame:
    """The canonical audit record as a struct with alphabetically ordered
    fields, next to the flat ordering columns (event_id, ts, source_system).
    Risk columns are used when present (output of ``flag_risk``). An event whose
    type is null or not registered stays, under its own type and the source
    ``UNKNOWN``. The registry has a few dozen rows: it is broadcast."""
    j = audit.join(F.broadcast(registry), audit.event_type == registry.raw_type, "left")
    j = (j.withColumn("source_system", F.coalesce("source_system", F.lit(UNKNOWN)))
          .withColumn("event_type_canonical", F.coalesce("event_type_canonical", "event_type", F.lit(UNKNOWN))))
    if "risk_level" not in audit.columns:
        j = j.withColumn("risk_level", F.lit("LOW")).withColumn("risk_flags", F.array().cast("array<string>"))
    detail = F.to_json(F.struct(F.col("query_id").alias("query_id"), F.col("rows_scanned"),
                                F.col("rows_returned"), F.col("duration_ms"),
                                F.col("ranger_decision").alias("decision")))
    event = F.struct(
        F.struct(detail.alias("detail"), F.col("action_type").alias("type")).alias("action"),
        F.struct(F.col("source_ip").alias("ip_address"), F.col("user_sub").alias("sub"),
                 F.col("tenant_id").alias("tenant_id"), F.lit("USER").alias("type"),
                 F.col("username").alias("username")).alias("actor"),
        F.col("event_id").alias("event_id"),
        F.col("event_type_canonical").alias("event_type"),
        F.when(F.col("ranger_decision") == "DENY", "FAILURE").otherwise("SUCCESS").alias("outcome"),
        F.struct(F.element_at("tables_accessed", 1).alias("identifier"), F.col("cluster").alias("location"),
                 F.lit("iceberg.table").alias("type")).alias("resource"),
        F.struct(F.coalesce(F.col("risk_flags"), F.array().cast("array<string>")).alias("flags"),
                 F.coalesce(F.col("risk_level"), F.lit("LOW")).alias("level")).alias("risk"),
        F.lit("1.0").alias("schema_version"),
        F.col("cluster").alias("source_host"),
        F.lit(cluster_ns).alias("source_namespace"),
        F.col("source_system").alias("source_system"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
    )
    return j.select("event_id", F.col("timestamp").alias("ts"), "source_system", "query_id",
                    event.alias("event"))


# ---------------------------------------------------------------------------
# Audit queries
# ---------------------------------------------------------------------------

def audit_by_user(audit: DataFrame, user_sub: str, now: str, days: int = 90) -> DataFrame:
    """G9 (SOC2): all queries by a user in the last N days, newest first."""
    return (audit.filter((F.col("user_sub") == user_sub) & since("timestamp", days, now))
                 .select("timestamp", "username", "tenant_id", "query_id", "tables_accessed", "rows_scanned",
                         "ranger_decision", "duration_ms")
                 .orderBy(F.col("timestamp").desc(), F.col("query_id")))


def audit_by_table(audit: DataFrame, table: str, now: str, days: int = 30) -> DataFrame:
    """G9 (GDPR art. 30): accesses to a personal-data table in the last N days."""
    return (audit.filter(F.array_contains("tables_accessed", table) & since("timestamp", days, now))
                 .select("timestamp", "username", "tenant_id", "tables_accessed", "ranger_decision",
                         "sql_text_hash", "query_id")
                 .orderBy(F.col("timestamp").desc(), F.col("query_id")))


def erasure_events(certificates: DataFrame, actor: str = "gdpr-erasure-job") -> DataFrame:
    """Compliance events written when an erasure completes."""
    return certificates.select(
        F.col("completed_at").alias("timestamp"), F.lit("compliance.erasure.completed").alias("event_type"),
        F.struct(F.lit(actor).alias("username")).alias("actor"),
        F.struct(F.struct(F.col("subject_id"), F.col("tables_affected"),
                          F.col("certificate_id").alias("erasure_certificate_id")).alias("detail")).alias("action"))


def erasure_certificates(events: DataFrame, subject_id: str | None = None) -> DataFrame:
    """Erasure certificate lookup over compliance events."""
    e = events.filter(F.col("event_type") == "compliance.erasure.completed")
    if subject_id is not None:
        e = e.filter(F.col("action.detail.subject_id") == subject_id)
    return e.select("timestamp", F.col("actor.username").alias("username"),
                    F.col("action.detail.subject_id").alias("subject_id"),
                    F.col("action.detail.tables_affected").alias("tables_affected"),
                    F.col("action.detail.erasure_certificate_id").alias("erasure_certificate_id"))


def access_in_window(audit: DataFrame, start: str, end: str, user: str | None = None) -> DataFrame:
    """Access history of the incident window (optionally one user)."""
    cond = (F.col("timestamp") >= ts_lit(start)) & (F.col("timestamp") < ts_lit(end))
    if user is not None:
        cond = cond & (F.col("username") == user)
    return audit.filter(cond)


def denial_spikes(audit: DataFrame, window: str = "1 hour", min_denials: int = 3) -> DataFrame:
    """Users with at least N denied requests in a tumbling window."""
    d = audit.filter(F.col("ranger_decision") == "DENY")
    g = d.groupBy("username", F.window("timestamp", window).alias("w")).agg(F.count(F.lit(1)).alias("denials"))
    return g.filter(F.col("denials") >= min_denials).select(
        "username", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "denials")


def append_only_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the earlier version that are missing or changed in the
    later one (anti join on a hash of the whole row)."""
    from lakeweave.functions.columns import row_hash
    cols = before.columns
    b = before.withColumn("__h", row_hash(cols))
    a = after.select(row_hash(cols).alias("__h")).distinct()
    return b.join(a, "__h", "left_anti").drop("__h")


def correlate_audit(a: DataFrame, b: DataFrame, key: str, max_gap_seconds: float,
                    a_ts: str = "ts_a", b_ts: str = "ts_b") -> DataFrame:
    """Pairs of entries from two systems with the same request id and
    timestamps at most ``max_gap_seconds`` apart (equi-join + band filter)."""
    j = a.join(b, key)
    gap = F.abs(seconds_between(F.col(a_ts), F.col(b_ts)))
    return j.filter(gap <= max_gap_seconds).withColumn("gap_seconds", gap)


def usage_by_tenant(audit: DataFrame, exact_percentile: bool = False) -> DataFrame:
    """Per tenant and user: queries, rows scanned / returned, duration
    totals and p95. ``exact_percentile`` is only for bounded-domain columns;
    the default approximation has bounded memory per group."""
    p95 = (F.percentile(F.col("duration_ms"), 0.95) if exact_percentile
           else F.percentile_approx("duration_ms", 0.95, 10000).cast("double"))
    return audit.groupBy("tenant_id", "username").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("rows_scanned").alias("rows_scanned"),
        F.sum("rows_returned").alias("rows_returned"), F.sum("duration_ms").alias("duration_ms"),
        p95.alias("p95_duration_ms"))


# Audited resources and access types of the audit policy.
AUDIT_POLICY = {"schemas": ["curated", "raw"], "tables": ["customers", "orders"],
                "access_types": ["select", "insert", "update", "delete"],
                "include_permit": True, "include_deny": True}


def select_audited(decisions: DataFrame, policy: dict = AUDIT_POLICY) -> DataFrame:
    """Decisions that the audit policy records."""
    dec_ok = F.lit(False)
    if policy.get("include_permit"):
        dec_ok = dec_ok | (F.col("decision") == "ALLOW")
    if policy.get("include_deny"):
        dec_ok = dec_ok | (F.col("decision") == "DENY")
    return decisions.filter(F.col("schema").isin(*policy["schemas"]) & F.col("table").isin(*policy["tables"])
                            & F.col("access").isin(*policy["access_types"]) & dec_ok)


def growth_anomaly(df: DataFrame, ts: str, days: int = 7, factor: float = 5.0) -> DataFrame:
    """Days whose row count exceeds ``factor`` x the mean of the previous
    ``days`` days. The window has no partition key, so it runs only on the
    daily aggregate (one row per day)."""
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn("rolling_avg", F.avg("rows").over(w)) \
                .withColumn("anomaly", F.coalesce(F.col("rows") > factor * F.col("rolling_avg"), F.lit(False)))
