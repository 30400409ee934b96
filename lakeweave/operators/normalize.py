"""Audit records from each source's own format.

Every source writes JSON of its own shape. A line is parsed once into a VARIANT, and a mapping
table says, for each source, where the canonical fields lie; fields that a source lacks are
null. The mapping is data: a new source is some more rows. All of it is one projection; nothing is
joined or shuffled. Lines that cannot be normalised (no JSON, unknown source, no id or time) are
kept aside with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.columns import from_epoch_micros

#: Canonical field, its path in the source's record, and its type. ``time`` fields carry an offset ("instant") or are UTC ("plain").
#: Formats: query-engine completion events, secret-store audit log, access-service audit.
MAPPINGS: dict[str, list[tuple[str, str, str]]] = {
    "trino": [
        ("event_id", "$.eventId", "string"), ("instant", "$.createTime", "string"), ("sub", "$.context.principal", "string"),
        ("username", "$.context.user", "string"), ("tenant_id", "$.context.tenant", "string"), ("ip_address", "$.context.remoteClientAddress", "string"),
        ("failed", "$.failureInfo.errorCode", "string"), ("operation", "$.queryType", "string"), ("identifier", "$.tables[0]", "string"),
        ("location", "$.cluster", "string")],
    "openbao": [
        ("event_id", "$.request.id", "string"), ("instant", "$.time", "string"), ("sub", "$.auth.entity_id", "string"),
        ("username", "$.auth.display_name", "string"), ("tenant_id", "$.auth.metadata.tenant", "string"),
        ("ip_address", "$.request.remote_address", "string"), ("failed", "$.error", "string"), ("operation", "$.request.operation", "string"),
        ("identifier", "$.request.path", "string"), ("location", "$.request.mount_point", "string")],
    "ranger": [
        ("event_id", "$.id", "string"), ("plain", "$.evtTime", "string"), ("sub", "$.additional_info.sub", "string"),
        ("username", "$.reqUser", "string"), ("tenant_id", "$.additional_info.tenant", "string"), ("ip_address", "$.cliIP", "string"),
        ("denied", "$.result", "int"), ("operation", "$.access", "string"), ("identifier", "$.resource", "string"), ("location", "$.repo", "string")],
}

#: The fields of each source's detail object, with their place in its record.
DETAILS: dict[str, list[tuple[str, str, str]]] = {
    "trino": [
        ("query_id", "$.queryId", "string"), ("query_type", "$.queryType", "string"), ("sql_text_hash", "$.queryHash", "string"),
        ("sql_text", "$.query", "string"), ("catalog", "$.context.catalog", "string"), ("schema", "$.context.schema", "string"),
        ("tables_accessed", "$.tables", "array<string>"), ("rows_scanned", "$.statistics.totalRows", "bigint"),
        ("rows_returned", "$.statistics.outputRows", "bigint"), ("bytes_processed", "$.statistics.totalBytes", "bigint"),
        ("duration_ms", "$.statistics.wallMillis", "bigint"), ("cluster", "$.cluster", "string"), ("worker_nodes", "$.statistics.workers", "int"),
        ("ranger_decisions", "$.decisions", "array<struct<resource:string,action:string,decision:string,row_filter:string,masked_columns:array<string>>>")],
    "openbao": [
        ("path", "$.request.path", "string"), ("operation", "$.request.operation", "string"), ("vault_request_id", "$.request.id", "string"),
        ("remote_address", "$.request.remote_address", "string"), ("auth_method", "$.auth.metadata.method", "string"),
        ("auth_role", "$.auth.metadata.role", "string"), ("lease_created", "$.response.lease.created", "boolean"), ("lease_ttl", "$.response.lease.ttl", "bigint")],
    "ranger": [
        ("request_id", "$.id", "string"), ("policy_name", "$.policy_name", "string"), ("service_name", "$.repo", "string"),
        ("resource", "$.resource_elements", "struct<catalog:string,database:string,table:string,column:string>"), ("access_type", "$.access", "string"),
        ("row_filter_expression", "$.row_filter", "string"),
        ("masking_info", "$.masking", "array<struct<column:string,mask_type:string>>"), ("policy_version", "$.policy_version", "string")],
}

RESOURCE_TYPES = {"trino": "iceberg.table", "openbao": "openbao.secret", "ranger": "iceberg.table"}
#: Event and action type by the operation of the secret store.
SECRET_OPERATIONS = [("read", "secret.read", "READ"), ("list", "secret.read", "READ"), ("create", "secret.write", "WRITE"),
                     ("update", "secret.write", "WRITE"), ("delete", "secret.delete", "DELETE")]


def _by_source(source: Column, values: dict[str, Column], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, value in values.items():
        out = F.when(source == name, value.cast(kind)).otherwise(out)
    return out


def _field(v: Column, source: Column, name: str, kind: str = "string", mappings=None) -> Column:
    found = {s: F.try_variant_get(v, path, k) for s, fields in (mappings or MAPPINGS).items() for f, path, k in fields if f == name}
    return _by_source(source, found, kind)


def _detail(v: Column, source: Column) -> Column:
    """The detail object as JSON, fields in alphabetical order, without those that are null."""
    whole = {}
    for s, fields in DETAILS.items():
        columns = [F.try_variant_get(v, path, kind).alias(name) for name, path, kind in fields]
        if s == "ranger":
            columns.append(F.when(F.try_variant_get(v, "$.result", "int") == 1, "ALLOWED").otherwise("DENIED").alias("result"))
            fields = [*fields, ("result", "", "")]
        order = sorted(range(len(columns)), key=lambda i: fields[i][0])
        whole[s] = F.to_json(F.struct(*[columns[i] for i in order]))
    return _by_source(source, whole, "string")


def parsed(lines: DataFrame, source: str = "source", raw: str = "raw") -> DataFrame:
    """``lines`` with the canonical fields as flat columns under ``_n`` and the reason under ``_reason`` (null: normalised)."""
    s, v = F.col(source), F.col("_v")
    # Exploded arrays of one element: the line is parsed, and its fields are taken, once and not per use
    rows = lines.select("*", F.explode(F.array(F.try_parse_json(F.col(raw)))).alias("_v"))
    instant = F.unix_micros(_field(v, s, "instant").try_cast("timestamp"))
    plain = _field(v, s, "plain").try_cast("timestamp_ntz")
    ts = F.coalesce(F.when(_field(v, s, "instant").rlike(r"(Z|[+-]\d\d:?\d\d)$"), from_epoch_micros(instant)), plain)
    op, failed, denied = F.lower(_field(v, s, "operation")), _field(v, s, "failed"), _field(v, s, "denied", "int")
    bad = F.coalesce(failed != "", F.lit(False)) | F.coalesce(denied != 1, F.lit(False))
    event = F.when(s == "trino", F.when(bad, "data.query.rejected").otherwise("data.query.executed")) \
             .when(s == "ranger", F.when(bad, "data.access.denied").otherwise("data.access.allowed"))
    action = F.when(s == "trino", F.when(op.isin("insert", "update", "merge", "delete"), "WRITE").otherwise("READ")).when(s == "ranger", "READ")
    for o, e, a in SECRET_OPERATIONS:
        event, action = event.when((s == "openbao") & (op == o), e), action.when((s == "openbao") & (op == o), a)
    n = F.struct(_field(v, s, "event_id").alias("event_id"), ts.alias("ts"), event.alias("event_type"), action.alias("action_type"),
                 F.when(bad, "FAILURE").otherwise("SUCCESS").alias("outcome"), _field(v, s, "sub").alias("sub"),
                 _field(v, s, "username").alias("username"), _field(v, s, "tenant_id").alias("tenant_id"), _field(v, s, "ip_address").alias("ip_address"),
                 _by_source(s, {k: F.lit(t) for k, t in RESOURCE_TYPES.items()}, "string").alias("resource_type"),
                 _field(v, s, "identifier").alias("identifier"), _field(v, s, "location").alias("location"), _detail(v, s).alias("detail"))
    rows = rows.select(*lines.columns, F.explode(F.array(F.struct(n.alias("n"), v.isNull().alias("empty")))).alias("_x"))
    rows = rows.select(*lines.columns, F.col("_x.n").alias("_n"), F.col("_x.empty").alias("_empty"))
    n, known = F.col("_n"), s.isin(*MAPPINGS)
    reason = (F.when(~F.coalesce(known, F.lit(False)), "unknown source").when(F.col("_empty"), "no JSON")
              .when(n["event_id"].isNull(), "no event id").when(n["ts"].isNull(), "no time").when(n["event_type"].isNull(), "unknown operation"))
    return rows.withColumn("_reason", reason).drop("_empty")


def normalize_raw(lines: DataFrame, source: str = "source", raw: str = "raw", namespace: str = "lakehouse") -> tuple[DataFrame, DataFrame]:
    """(canonical events, rejected lines with ``reason``).

    Events have the columns of ``audit.normalize_events`` (``event_id``, ``ts``, ``source_system``, ``query_id``, ``event``), so
    they can be chained. Good and rejected lines together are the input."""
    p = parsed(lines, source, raw)
    n = F.col("_n")
    event = F.struct(
        F.struct(n["detail"].alias("detail"), n["action_type"].alias("type")).alias("action"),
        F.struct(n["ip_address"].alias("ip_address"), n["sub"].alias("sub"), n["tenant_id"].alias("tenant_id"),
                 F.lit("USER").alias("type"), n["username"].alias("username")).alias("actor"),
        n["event_id"].alias("event_id"), n["event_type"].alias("event_type"), n["outcome"].alias("outcome"),
        F.struct(n["identifier"].alias("identifier"), n["location"].alias("location"), n["resource_type"].alias("type")).alias("resource"),
        F.struct(F.array().cast("array<string>").alias("flags"), F.lit("LOW").alias("level")).alias("risk"),
        F.lit("1.0").alias("schema_version"), n["location"].alias("source_host"), F.lit(namespace).alias("source_namespace"),
        F.col(source).alias("source_system"), F.date_format(n["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))
    good = p.filter("_reason IS NULL").select(n["event_id"].alias("event_id"), n["ts"].alias("ts"), F.col(source).alias("source_system"),
                                              F.get_json_object(n["detail"], "$.query_id").alias("query_id"), event.alias("event"))
    return good, p.filter("_reason IS NOT NULL").withColumn("reason", F.col("_reason")).drop("_n", "_reason")


def native_lines(audit: DataFrame, number: str = "number", key: Sequence[str] = ("click", "view")) -> DataFrame:
    """Lines in the three formats from the flat audit table with a row ``number``: queries of the event types ``key`` as query-engine
    events, sign-ups as secret reads, writes and deletes, the rest as access decisions; some lines are cut or of no known source."""
    k, et = F.col(number), F.col("event_type")
    source = F.when(k % 41 == 0, "ftp").when(et.isin(*key), "trino").when(et == "signup", "openbao").otherwise("ranger")
    parts = F.split(F.element_at("tables_accessed", 1), r"\.")
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(k % 2 == 0, "Z").otherwise("+00:00"))
    trino = F.to_json(F.struct(
        F.col("event_id").alias("eventId"), F.col("query_id").alias("queryId"), iso.alias("createTime"), F.lit("SELECT").alias("queryType"),
        F.col("sql_text").alias("query"), F.col("sql_text_hash").alias("queryHash"), F.col("tables_accessed").alias("tables"), F.col("cluster"),
        F.struct(F.col("user_sub").alias("principal"), F.col("username").alias("user"), F.col("tenant_id").alias("tenant"),
                 F.col("source_ip").alias("remoteClientAddress"), F.lit("trino").alias("catalog"), F.concat_ws(".", parts[0], parts[1]).alias("schema")).alias("context"),
        F.struct(F.col("rows_scanned").alias("totalRows"), F.col("rows_returned").alias("outputRows"), F.col("duration_ms").alias("wallMillis"),
                 F.lit(4).alias("workers")).alias("statistics"),
        F.when(k % 23 == 0, F.struct(F.lit("PERMISSION_DENIED").alias("errorCode"))).alias("failureInfo"),
        F.array(F.struct(F.element_at("tables_accessed", 1).alias("resource"), F.lit("SELECT").alias("action"), F.col("ranger_decision").alias("decision"))).alias("decisions")))
    bao = F.to_json(F.struct(
        iso.alias("time"), F.lit("response").alias("type"), F.when(k % 19 == 0, "permission denied").otherwise("").alias("error"),
        F.struct(F.col("user_sub").alias("entity_id"), F.col("username").alias("display_name"),
                 F.struct(F.col("tenant_id").alias("tenant"), F.lit("approle").alias("method"), F.lit("coordinator").alias("role")).alias("metadata")).alias("auth"),
        F.struct(F.col("event_id").alias("id"), F.when(k % 3 == 0, "read").when(k % 3 == 1, "update").otherwise("delete").alias("operation"),
                 F.concat(F.lit("secret/"), F.col("username")).alias("path"), F.col("source_ip").alias("remote_address"), F.lit("secret/").alias("mount_point")).alias("request"),
        F.struct(F.struct((k % 2 == 0).alias("created"), F.when(k % 2 == 0, F.lit(3600)).alias("ttl")).alias("lease")).alias("response")))
    ranger = F.to_json(F.struct(
        F.col("event_id").alias("id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("evtTime"), F.col("username").alias("reqUser"),
        F.lit("select").alias("access"), F.when(F.col("ranger_decision") == "DENY", 0).otherwise(1).alias("result"), F.col("source_ip").alias("cliIP"),
        F.lit("trino").alias("repo"), F.element_at("tables_accessed", 1).alias("resource"), F.lit("2").alias("policy_version"),
        F.concat(F.col("tenant_id"), F.lit("_select")).alias("policy_name"), F.concat(F.lit("tenant_id = '"), F.col("tenant_id"), F.lit("'")).alias("row_filter"),
        F.struct(F.lit("trino").alias("catalog"), F.concat_ws(".", parts[0], parts[1]).alias("database"), parts[2].alias("table"), F.lit("*").alias("column")).alias("resource_elements"),
        F.struct(F.col("user_sub").alias("sub"), F.col("tenant_id").alias("tenant")).alias("additional_info")))
    line = F.when(et.isin(*key), trino).when(et == "signup", bao).otherwise(ranger)
    line = F.when(k % 53 == 0, F.substring(line, 1, 40)).when(k % 59 == 0, F.regexp_replace(line, r'"(createTime|time|evtTime)":"[^"]*"', '"$1":"soon"')).otherwise(line)
    return audit.select(k.alias(number), source.alias("source"), line.alias("raw"))
