"""S1 table scan and the fixture-derived business tables (FIXTURES.md §2).

Every derivation is a plain projection of the driver tables: no random data,
no driver-side rows, so each one scales with its input and Catalyst can push
filters and column pruning through it into the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.columns import ts_lit, uuid_from_md5, zpad
from lakeweave.session import ensure_parallelism

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed run timestamp: models stamp it instead of the wall clock.
RUN_TS = dt.datetime(2024, 2, 1, 0, 0, 0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the fixture directory."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation/region are fixed-size dimensions (25 / 5 rows at any scale), so an
    # explicit broadcast is bounded by construction.
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
                       .select("n_nationkey", "n_name", "r_name"))


def _cust_id(key: Column) -> Column:
    return F.concat(F.lit("CUST-"), zpad(key, 6))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.customers: messy strings so that P1 has work to do."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ks = k.cast("string")
    month = zpad((k % 12 + 1).cast("string"), 2)
    day = zpad((k % 28 + 1).cast("string"), 2)
    return (c.join(_nation_names(spark, sf_dir), c.c_nationkey == F.col("n_nationkey"), "left")
            .select(
                _cust_id(k).alias("customer_id"),
                F.when(k % 60 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit(" User"), ks, F.lit("@Example"), (k % 5 + 1).cast("string"),
                                     F.lit(".com "))).alias("email"),
                F.concat(F.lit(" "), F.col("c_name")).alias("first_name"),
                F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("last_name"),
                F.lower(F.col("n_name")).alias("country"),
                F.when(k % 50 == 0, F.lit("n/a"))
                 .otherwise(F.concat(F.lit("2020-"), month, F.lit("-"), day, F.lit(" 10:00:00"))).alias("created_at"),
                F.when(k % 50 == 25, F.lit("unknown"))
                 .otherwise(F.concat(F.lit("2023-"), month, F.lit("-15 08:30:00"))).alias("updated_at"),
                ts_lit(RUN_TS).alias("_ingested_at"),
            ))


def _status_word() -> Column:
    s = F.col("o_orderstatus")
    return (F.when(s == "P", "pending").when(s == "O", "processing").when(s == "F", "completed"))


def raw_orders(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """raw.orders: status spelled with case/blank variants every 7th row.
    ``orders`` may be given instead (e.g. a streaming read of the table)."""
    o = orders if orders is not None else read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = _status_word()
    return o.select(
        k.alias("order_id"),
        _cust_id(F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("order_date"),
        F.when(k % 14 == 0, F.upper(base))
         .when(k % 14 == 7, F.concat(F.lit("  "), base, F.lit(" ")))
         .otherwise(base).alias("status"),
        F.col("o_totalprice").alias("total_amount"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .when(k % 10 == 5, F.lit(" eur "))
         .otherwise(F.lit("usd")).alias("currency"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).cast("string").alias("updated_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAYS")).alias("_ingested_at"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw.products: price NULL or non-positive every 40th row."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.when(k % 40 == 0, F.lit(None).cast("double"))
         .when(k % 40 == 20, -F.col("p_retailprice"))
         .otherwise(F.col("p_retailprice")).alias("price"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit(" usd")).alias("currency"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .when(k % 11 == 1, F.lit(" Discontinued"))
         .otherwise(F.lit("ACTIVE")).alias("status"),
        ts_lit(RUN_TS).alias("_ingested_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curated.order_items over lineitem. item_id is (orderkey, linenumber), which
    repeats in the fixtures: that is the input of the deduplication operator."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_price"),
        F.col("l_shipdate").alias("updated_at"),
    )


# ---------------------------------------------------------------------------
# Event-derived tables
# ---------------------------------------------------------------------------

def _source_system(event_type: Column) -> Column:
    return (F.when(event_type == "signup", "crm").when(event_type == "purchase", "pos")
            .when(event_type == "click", "web").when(event_type == "view", "mobile")
            .otherwise("partner_api"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw landing batch validated by the raw-layer suite."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        uuid_from_md5(F.col("event_id").cast("string")).alias("event_id"),
        F.col("ts").alias("event_timestamp"),
        _source_system(F.col("event_type")).alias("source_system"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTES")).alias("ingestion_timestamp"),
        F.col("props").alias("payload"),
    )


def _tenant(n: Column) -> Column:
    return F.when(n % 3 == 0, "tenant_a").when(n % 3 == 1, "tenant_b").otherwise("tenant_c")


def audit_queries(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The flat query-audit table (one row per executed query)."""
    e = events if events is not None else ensure_parallelism(read_table(spark, sf_dir, "events"))
    uid, eid, et = F.col("user_id"), F.col("event_id"), F.col("event_type")
    # every 7th query touches a table of the next tenant: cross-tenant access
    owner = _tenant(uid + F.when(eid % 7 == 0, 1).otherwise(0))
    tbl = (F.when(et == "signup", F.concat(owner, F.lit(".marts.customers")))
           .when(et == "purchase", F.concat(owner, F.lit(".marts.orders")))
           .when(et == "click", F.concat(owner, F.lit(".staging.events")))
           .when(et == "view", F.concat(owner, F.lit(".marts.products")))
           .otherwise(F.concat(owner, F.lit(".raw.customers"))))
    tables = F.when(et == "purchase", F.array(tbl, F.concat(owner, F.lit(".marts.customers")))) \
              .otherwise(F.array(tbl))
    sql_text = F.concat(F.lit("SELECT * FROM "), tbl, F.lit(" WHERE email = 'user"), uid.cast("string"),
                        F.lit("@example.com' AND k = "), F.get_json_object("props", "$.k"))
    return e.select(
        uuid_from_md5(F.concat(F.lit("q"), eid.cast("string"))).alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("sub-"), zpad(uid.cast("string"), 4)).alias("user_sub"),
        F.concat(F.lit("user"), uid.cast("string")).alias("username"),
        _tenant(uid).alias("tenant_id"),
        F.concat(F.lit("q_"), eid.cast("string")).alias("query_id"),
        F.sha2(sql_text, 256).alias("sql_text_hash"),
        sql_text.alias("sql_text"),
        tables.alias("tables_accessed"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("rows_scanned"),
        F.floor(F.col("value") * 10).cast("bigint").alias("rows_returned"),
        F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms"),
        F.when(et == "error", "DENY").otherwise("ALLOW").alias("ranger_decision"),
        F.concat(F.lit("cluster-"), (eid % 2).cast("string")).alias("cluster"),
        F.concat(F.lit("10.0."), (uid % 256).cast("string"), F.lit("."), (eid % 250 + 1).cast("string"))
         .alias("source_ip"),
        et.alias("event_type"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request samples for the SLO metrics: one sample per event, failed when
    the event is an error; value is the latency in seconds."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("ts"),
        F.col("event_type").alias("job"),
        F.concat(F.lit("inst-"), (F.col("user_id") % 4).cast("string")).alias("instance"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_s"),
        F.col("event_id"),
        F.col("user_id"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines: JSON bodies for trino / airflow / keycloak, the
    "ts level [thread] logger - message" layout for ranger-admin, with scrape
    noise and blank lines mixed in."""
    e = read_table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    service = (F.when(et.isin("click", "view"), "trino").when(et == "purchase", "airflow")
               .when(et == "signup", "keycloak").otherwise("ranger-admin"))
    level = F.when(et == "error", "ERROR").when(F.col("value") > 40, "WARN").otherwise("INFO")
    json_body = F.to_json(F.struct(
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), level.alias("level"),
        F.concat(F.lit("io.lake."), et).alias("logger"),
        F.concat(F.lit("query "), eid.cast("string"), F.lit(" took "), F.col("value").cast("string"))
         .alias("message"),
        et.alias("event_type"), F.col("user_id").alias("user_id")))
    text_body = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), level,
                         F.lit(" [worker-"), (F.col("user_id") % 8).cast("string"), F.lit("] io.lake."), et,
                         F.lit(" - event "), eid.cast("string"))
    body = (F.when(eid % 97 == 0, F.lit("   "))
            .when(eid % 89 == 0, F.concat(F.lit("GET /metrics/prometheus 200 "), eid.cast("string")))
            .when(service == "ranger-admin", text_body)
            .otherwise(json_body))
    return e.select(eid.alias("line_id"), service.alias("service"), body.alias("body"))
