"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator,
with the matching DuckDB SQL in ORACLES. Floating results are rounded in the
registered form only (Spark and DuckDB add in different orders); the library
operators themselves return exact values."""

from __future__ import annotations

from datetime import timedelta
from typing import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave.plans import benchmark as bm
from lakeweave.plans.oracle import RUN_TS_SQL, with_ctes
from lakeweave.plans.oracle import uuid as uuid_sql
from lakeweave.plans.oracle import zpad as zpad_sql
from lakeweave.sources import tables as src
from lakeweave.operators import models as mdl
from lakeweave.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return fn
    return deco


def rounded(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# Building blocks shared by many registered queries
# ---------------------------------------------------------------------------

def stg_customers_df(spark, d):
    return mdl.stg_customers(src.raw_customers(spark, d))


def stg_orders_df(spark, d):
    return mdl.stg_orders(src.raw_orders(spark, d))


def dim_df(spark, d):
    return mdl.dim_customers(stg_customers_df(spark, d), src.RUN_TS)


def fct_df(spark, d):
    return mdl.fct_orders(stg_orders_df(spark, d), dim_df(spark, d))


# ---------------------------------------------------------------------------
# Step 0/1: staging models, marts, benchmark
# ---------------------------------------------------------------------------

@register("p1_stg_customers", "SELECT * FROM stg_customers")
def _p1(spark, d):
    return stg_customers_df(spark, d)


@register("p2_stg_orders", "SELECT * FROM stg_orders")
def _p2(spark, d):
    return rounded(stg_orders_df(spark, d), ["total_amount_usd"])


@register("p3_stg_products", "SELECT * FROM stg_products")
def _p3(spark, d):
    return rounded(mdl.stg_products(src.raw_products(spark, d)), ["price"])


@register("t2_dim_customers", "SELECT * FROM dim_customers")
def _t2(spark, d):
    return dim_df(spark, d)


@register("t3_fct_orders", "SELECT * FROM fct_orders")
def _t3(spark, d):
    return rounded(fct_df(spark, d), ["total_amount_usd"])


@register("a1_rpt_revenue_by_region", f"""
    SELECT country, count(*) AS total_orders, count(CASE WHEN is_completed THEN 1 END) AS completed_orders,
           round(sum(total_amount_usd), 2) AS total_revenue_usd, round(avg(total_amount_usd), 2) AS avg_order_value_usd,
           CASE WHEN count(*) = 0 THEN 0.0
                ELSE CAST(count(CASE WHEN is_completed THEN 1 END) AS DOUBLE) / count(*) END AS completion_rate,
           {RUN_TS_SQL} AS _dbt_updated_at
    FROM fct_orders GROUP BY country""")
def _a1(spark, d):
    r = mdl.rpt_revenue_by_region(fct_df(spark, d), src.RUN_TS)
    return rounded(r, ["total_revenue_usd", "avg_order_value_usd"])


@register("a2_tpch_q1", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus""")
def _a2(spark, d):
    r = bm.q1(spark, d)
    r = rounded(r, ["sum_qty", "sum_base_price", "sum_disc_price", "sum_charge"])
    return rounded(rounded(r, ["avg_qty", "avg_price"], 4), ["avg_disc"], 6)


@register("a3_tpch_q3", """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00'
      AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate, o_orderpriority
    ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, o_orderdate, l_orderkey LIMIT 10""")
def _a3(spark, d):
    return rounded(bm.q3(spark, d), ["revenue"])


@register("a4_tpch_q6", """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def _a4(spark, d):
    return rounded(bm.q6(spark, d), ["revenue"])


@register("a5_tpch_q10", """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
         JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
      AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name
    ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, c_custkey LIMIT 20""")
def _a5(spark, d):
    return rounded(bm.q10(spark, d), ["revenue"])


@register("a6_tpch_q19", """
    SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE (p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO') AND l_quantity >= 1 AND l_quantity <= 11
           AND p_size BETWEEN 1 AND 5)
       OR (p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'STANDARD') AND l_quantity >= 10 AND l_quantity <= 20
           AND p_size BETWEEN 1 AND 10)
       OR (p_brand = 'Brand#4' AND p_type IN ('LARGE', 'ECONOMY') AND l_quantity >= 20 AND l_quantity <= 30
           AND p_size BETWEEN 1 AND 15)""")
def _a6(spark, d):
    return rounded(bm.q19(spark, d), ["revenue"])


# ---------------------------------------------------------------------------
# Step 1: remaining aggregates, joins, predicates, top-k, scalar functions
# ---------------------------------------------------------------------------

from lakeweave.functions import columns as fn  # noqa: E402
from lakeweave.operators import tables as tbl  # noqa: E402
from lakeweave.sources import generators as gen  # noqa: E402

CUTOFF = "1998-01-01"


def customer_regions(spark, d):
    """stg customers with their region name (nation is a 25-row dimension)."""
    nat = (src.read_table(spark, d, "nation").join(F.broadcast(src.read_table(spark, d, "region")),
                                                     F.col("n_regionkey") == F.col("r_regionkey"), "left")
           .select(F.upper("n_name").alias("country"), F.col("r_name").alias("region")))
    return stg_customers_df(spark, d).join(F.broadcast(nat), "country", "left") \
                                     .select("customer_id", "email", "region")


CUSTOMER_REGIONS_SQL = """
    SELECT s.customer_id, s.email, r_name AS region
    FROM stg_customers s LEFT JOIN (SELECT upper(n_name) AS country, r_name FROM nation_names) n
      ON s.country = n.country"""


@register("a7_count_by_status", "SELECT status, count(*) AS row_count FROM fct_orders GROUP BY status")
def _a7(spark, d):
    return mdl.count_by(fct_df(spark, d), ["status"])


@register("a8_distinct_customers", """
    SELECT count(*) AS row_count, count(customer_id) AS non_null, count(DISTINCT customer_id) AS distinct_count
    FROM fct_orders""")
def _a8(spark, d):
    return mdl.distinct_stats(fct_df(spark, d), "customer_id")


@register("a9_min_max_marks", """
    SELECT min(order_date) AS first_order_date, max(order_date) AS last_order_date,
           max(updated_at) AS max_updated_at, max(_ingested_at) AS max_ingested_at FROM fct_orders""")
def _a9(spark, d):
    return fct_df(spark, d).agg(F.min("order_date").alias("first_order_date"),
                                F.max("order_date").alias("last_order_date"),
                                F.max("updated_at").alias("max_updated_at"),
                                F.max("_ingested_at").alias("max_ingested_at"))


@register("a10_reconcile_raw_vs_mart", """
    SELECT a.rows_a, b.rows_b, round(abs(coalesce(a.s, 0) - coalesce(b.s, 0)), 2) AS diff_total_amount,
           a.rows_a = b.rows_b AND abs(coalesce(a.s, 0) - coalesce(b.s, 0)) < 0.01 AS passed
    FROM (SELECT count(*) AS rows_a, sum(total_amount) AS s FROM raw_orders) a,
         (SELECT count(*) AS rows_b, sum(total_amount_usd) AS s FROM fct_orders) b""")
def _a10(spark, d):
    r = mdl.reconcile(src.raw_orders(spark, d), fct_df(spark, d), [("total_amount", "total_amount_usd")])
    return rounded(r, ["diff_total_amount"])


@register("a11_customer_mart", f"""
    WITH cr AS ({CUSTOMER_REGIONS_SQL}),
    agg AS (SELECT customer_id, sum(total_amount_usd) AS total_revenue, count(*) AS order_count,
                   min(order_date) AS first_order_date, max(order_date) AS last_order_date
            FROM fct_orders GROUP BY customer_id)
    SELECT agg.customer_id, round(total_revenue, 2) AS total_revenue, order_count, first_order_date,
           last_order_date, cr.region, cr.email
    FROM agg LEFT JOIN cr ON agg.customer_id = cr.customer_id""")
def _a11(spark, d):
    return rounded(mdl.customer_mart(fct_df(spark, d), customer_regions(spark, d)), ["total_revenue"])


@register("j3_orphan_orders", """
    SELECT order_id, customer_id FROM fct_orders f
    WHERE NOT EXISTS (SELECT 1 FROM dim_customers d WHERE d.customer_id = f.customer_id)""")
def _j3(spark, d):
    return mdl.orphans(fct_df(spark, d), dim_df(spark, d), "customer_id").select("order_id", "customer_id")


@register("q13_revenue_not_positive", """
    SELECT order_id, total_amount_usd FROM fct_orders WHERE is_completed = TRUE AND total_amount_usd <= 0""")
def _q13(spark, d):
    return mdl.revenue_not_positive(fct_df(spark, d))


@register("k2_top5_customers_by_revenue", """
    SELECT c_custkey AS customer_id, c_name, CAST(500 + (c_custkey * 137) % 99500 AS DECIMAL(12,2)) AS annual_revenue
    FROM customer ORDER BY annual_revenue DESC, customer_id LIMIT 5""")
def _k2(spark, d):
    keys = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), "c_name")
    cur = gen.generate_customers(keys)
    return cur.select("customer_id", "c_name", "annual_revenue") \
              .orderBy(F.col("annual_revenue").desc(), F.col("customer_id")).limit(5)


@register("k4_sample_rows", """
    SELECT order_id, status, total_amount_usd FROM fct_orders
    ORDER BY md5(order_id), order_id LIMIT 100""")
def _k4(spark, d):
    f = fct_df(spark, d)
    return rounded(f.orderBy(F.md5("order_id"), "order_id").limit(100)
                   .select("order_id", "status", "total_amount_usd"), ["total_amount_usd"])


@register("p4_surrogate_key_items", """
    SELECT item_id, md5(coalesce(CAST(order_id AS VARCHAR), '_null_') || '|' || coalesce(CAST(line_number AS VARCHAR), '_null_')
                        || '|' || coalesce(CAST(product_id AS VARCHAR), '_null_')) AS item_key
    FROM order_items""")
def _p4(spark, d):
    oi = src.order_items(spark, d)
    return oi.select("item_id", fn.surrogate_key(["order_id", "line_number", "product_id"]).alias("item_key"))


@register("p5_safe_divide", """
    SELECT status, round(CASE WHEN count(CASE WHEN is_completed THEN 1 END) = 0 THEN 0.0
                              ELSE sum(total_amount_usd) / count(CASE WHEN is_completed THEN 1 END) END, 4) AS revenue_per_completed
    FROM fct_orders GROUP BY status""")
def _p5(spark, d):
    f = fct_df(spark, d)
    r = f.groupBy("status").agg(fn.safe_divide(F.sum("total_amount_usd"),
                                               F.count(F.when(F.col("is_completed"), 1))).alias("revenue_per_completed"))
    return rounded(r, ["revenue_per_completed"], 4)


@register("p6_predicates", """
    SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE l_quantity BETWEEN 5 AND 25 AND l_linestatus IN ('O', 'F')
      AND ((l_discount >= 0.05 AND l_tax < 0.04) OR (l_returnflag = 'R' AND l_extendedprice > 20000))
    GROUP BY l_returnflag""")
def _p6(spark, d):
    li = src.read_table(spark, d, "lineitem")
    pred = (F.col("l_quantity").between(5, 25) & F.col("l_linestatus").isin("O", "F")
            & (((F.col("l_discount") >= 0.05) & (F.col("l_tax") < 0.04))
               | ((F.col("l_returnflag") == "R") & (F.col("l_extendedprice") > 20000))))
    return li.filter(pred).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("p8_since_7_days", """
    SELECT query_id, username, "timestamp" FROM audit_queries
    WHERE "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""")
def _p8(spark, d):
    a = src.audit_queries(spark, d)
    return a.filter(fn.since("timestamp", 7, "2024-01-31 00:00:00")).select("query_id", "username", "timestamp")


@register("f_scalar_functions", """
    SELECT order_id,
           upper(trim(status)) || '/' || lower(currency) AS status_currency,
           lpad(CAST(CAST(order_id AS BIGINT) % 1000 AS VARCHAR), 5, '0') AS padded,
           CAST(order_id AS BIGINT) // 7 AS div7,
           CAST(order_id AS BIGINT) % 7 AS mod7,
           (['bronze', 'silver', 'gold', 'platinum'])[CAST(CAST(order_id AS BIGINT) % 4 + 1 AS INTEGER)] AS tier,
           CAST(date_trunc('month', order_date) AS DATE) AS order_month,
           CAST(order_date + INTERVAL 30 DAY AS DATE) AS due_date,
           coalesce(country, 'unknown') AS country,
           CASE WHEN total_amount_usd > 100000 THEN 'large' ELSE 'small' END AS size_class,
           sha256(order_id) AS order_hash,
           regexp_matches(customer_id, '^CUST-[0-9]{6,12}$') AS id_ok,
           CAST(CAST(order_id AS BIGINT) - (CAST(order_id AS BIGINT) % 1000) AS BIGINT) AS order_bucket
    FROM fct_orders""")
def _f(spark, d):
    f = fct_df(spark, d)
    oid = F.col("order_id").cast("bigint")
    return f.select(
        "order_id",
        F.concat(F.upper(F.trim("status")), F.lit("/"), F.lower("currency")).alias("status_currency"),
        F.lpad((oid % 1000).cast("string"), 5, "0").alias("padded"),
        F.expr("CAST(order_id AS BIGINT) div 7").alias("div7"),
        (oid % 7).alias("mod7"),
        F.element_at(F.array(*[F.lit(t) for t in gen.LOYALTY_TIERS]), (oid % 4 + 1).cast("int")).alias("tier"),
        F.trunc("order_date", "month").alias("order_month"),
        F.date_add("order_date", 30).alias("due_date"),
        F.coalesce("country", F.lit("unknown")).alias("country"),
        F.when(F.col("total_amount_usd") > 100000, "large").otherwise("small").alias("size_class"),
        F.sha2("order_id", 256).alias("order_hash"),
        F.col("customer_id").rlike(r"^CUST-[0-9]{6,12}$").alias("id_ok"),
        fn.truncate_bucket(oid, 1000).alias("order_bucket"),
    )


# ---------------------------------------------------------------------------
# Step 2: merge, incremental build, dedupe, time travel, history, maintenance
# ---------------------------------------------------------------------------

def _fct_batch1(spark, d):
    raw1 = src.raw_orders(spark, d).filter(F.col("order_date") < CUTOFF)
    return mdl.fct_orders(mdl.stg_orders(raw1), dim_df(spark, d))


@register("t1_merge_upsert", f"""
    WITH tgt AS (SELECT * FROM fct_orders WHERE order_date < DATE '{CUTOFF}'),
    upd AS (SELECT * FROM fct_orders WHERE order_date >= DATE '{CUTOFF}'
            UNION ALL
            SELECT * REPLACE (total_amount_usd + 100 AS total_amount_usd) FROM fct_orders
            WHERE order_date < DATE '{CUTOFF}' AND CAST(order_id AS BIGINT) % 9 = 0)
    SELECT order_id, status, round(total_amount_usd, 2) AS total_amount_usd, country FROM (
      SELECT * FROM tgt WHERE NOT EXISTS (SELECT 1 FROM upd WHERE upd.order_id = tgt.order_id)
      UNION ALL SELECT * FROM upd)""")
def _t1(spark, d):
    full = fct_df(spark, d)
    target = _fct_batch1(spark, d)
    upd = full.filter(F.col("order_date") >= CUTOFF).unionByName(
        full.filter((F.col("order_date") < CUTOFF) & (F.col("order_id").cast("bigint") % 9 == 0))
            .withColumn("total_amount_usd", F.col("total_amount_usd") + 100))
    m = tbl.merge_upsert(target, upd, ["order_id"])
    return rounded(m.select("order_id", "status", "total_amount_usd", "country"), ["total_amount_usd"])


@register("t3_fct_orders_incremental", "SELECT * FROM fct_orders")
def _t3i(spark, d):
    existing = _fct_batch1(spark, d)
    inc = mdl.fct_orders(stg_orders_df(spark, d), dim_df(spark, d), existing=existing)
    return rounded(inc, ["total_amount_usd"])


@register("w1_dedupe_order_items", """
    SELECT * FROM order_items
    QUALIFY row_number() OVER (PARTITION BY order_id, line_number
                               ORDER BY updated_at DESC, item_id DESC, product_id DESC, quantity DESC,
                                        unit_price DESC, discount_pct DESC, total_price DESC) = 1""")
def _w1(spark, d):
    # per-row arithmetic is bit-identical in both engines: no rounding needed
    return tbl.dedupe_latest(src.order_items(spark, d), ["order_id", "line_number"], ["updated_at"])


def changes_df(spark, d):
    return tbl.order_changes(src.read_table(spark, d, "orders"))


@register("t4_as_of_version", """
    SELECT order_id, version, committed_at, customer_id, status, round(amount, 2) AS amount FROM order_changes
    WHERE version <= 60
    QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC) = 1 AND op <> 'D'""")
def _t4v(spark, d):
    return rounded(tbl.as_of(changes_df(spark, d), ["order_id"], version=60), ["amount"])


@register("t4_as_of_timestamp", """
    SELECT order_id, version, committed_at, customer_id, status, round(amount, 2) AS amount FROM order_changes
    WHERE committed_at <= TIMESTAMP '2000-06-30 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC) = 1 AND op <> 'D'""")
def _t4t(spark, d):
    return rounded(tbl.as_of(changes_df(spark, d), ["order_id"], ts="2000-06-30 00:00:00"), ["amount"])


SNAPSHOTS_SQL = """
    SELECT version AS snapshot_id, min(committed_at) AS committed_at,
           CAST(sum(CASE WHEN op = 'I' THEN 1 ELSE 0 END) AS BIGINT) AS added_records,
           CAST(sum(CASE WHEN op = 'U' THEN 1 ELSE 0 END) AS BIGINT) AS updated_records,
           CAST(sum(CASE WHEN op = 'D' THEN 1 ELSE 0 END) AS BIGINT) AS deleted_records,
           'orders' AS table_name
    FROM order_changes GROUP BY version"""


@register("s16_snapshot_log", SNAPSHOTS_SQL)
def _s16(spark, d):
    return tbl.snapshot_log(changes_df(spark, d))


@register("k3_latest_snapshots", SNAPSHOTS_SQL + " ORDER BY committed_at DESC, snapshot_id DESC LIMIT 5")
def _k3(spark, d):
    return tbl.snapshot_log(changes_df(spark, d)).orderBy(F.col("committed_at").desc(),
                                                          F.col("snapshot_id").desc()).limit(5)


@register("t5_expirable_snapshots", f"""
    WITH s AS ({SNAPSHOTS_SQL})
    SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY committed_at DESC, snapshot_id DESC) AS recency_rank,
           row_number() OVER (PARTITION BY table_name ORDER BY committed_at DESC, snapshot_id DESC) > 5
             AND committed_at < TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 7 DAY AS expire
    FROM s""")
def _t5(spark, d):
    return tbl.expirable(tbl.snapshot_log(changes_df(spark, d)), "2001-12-01 00:00:00", 7, 5)


@register("w8_scd2_order_status", """
    WITH c AS (SELECT * FROM order_changes WHERE op <> 'D'),
    m AS (SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY committed_at) AS prev_status,
                 row_number() OVER (PARTITION BY order_id ORDER BY committed_at) AS rn FROM c),
    k AS (SELECT order_id, version, committed_at, op, customer_id, status, amount FROM m
          WHERE rn = 1 OR prev_status IS DISTINCT FROM status)
    SELECT order_id, version, committed_at, op, customer_id, status, round(amount, 2) AS amount,
           committed_at AS valid_from,
           lead(committed_at) OVER (PARTITION BY order_id ORDER BY committed_at) AS valid_to,
           lead(committed_at) OVER (PARTITION BY order_id ORDER BY committed_at) IS NULL AS is_current
    FROM k""")
def _w8(spark, d):
    c = changes_df(spark, d).filter(F.col("op") != "D")
    return rounded(tbl.scd2(c, ["order_id"], "committed_at", ["status"]), ["amount"])


FILES_SQL = """
    SELECT 'lineitem/ship_month=' || partition || '/chunk-' || CAST(chunk AS VARCHAR) || '.parquet' AS path,
           partition, n * 120 AS size_bytes, modified_at
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS partition, CAST(floor(l_orderkey / 1000) AS BIGINT) AS chunk,
                 count(*) AS n, max(l_shipdate) AS modified_at
          FROM lineitem GROUP BY 1, 2)"""


def files_df(spark, d):
    return tbl.lineitem_files(src.read_table(spark, d, "lineitem"))


@register("t6_orphan_files", f"""
    WITH f AS ({FILES_SQL})
    SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f r WHERE r.path = f.path AND (r.size_bytes / 120) % 7 <> 0)
      AND modified_at < TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 3 DAY""")
def _t6(spark, d):
    f = files_df(spark, d)
    referenced = f.filter((F.col("size_bytes") / 120) % 7 != 0)
    return tbl.orphan_files(f, referenced, "2001-12-01 00:00:00", 3)


@register("t7_compaction_plan", f"""
    WITH f AS ({FILES_SQL}),
    c AS (SELECT *, count(*) OVER (PARTITION BY partition) AS files_in_partition FROM f)
    SELECT *, sum(size_bytes) OVER (PARTITION BY partition ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_bytes,
           CAST(floor((sum(size_bytes) OVER (PARTITION BY partition ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                       - size_bytes) / 50000) AS BIGINT) AS rewrite_group
    FROM c WHERE files_in_partition >= 10""")
def _t7(spark, d):
    return tbl.compaction_plan(files_df(spark, d), min_files=10, target_bytes=50_000)


@register("t8_diff_versions", """
    WITH a AS (SELECT * EXCLUDE (op) FROM order_changes WHERE version <= 60
               QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC) = 1 AND op <> 'D'),
    b AS (SELECT * EXCLUDE (op) FROM order_changes WHERE version <= 61
          QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC) = 1 AND op <> 'D')
    SELECT coalesce(b.order_id, a.order_id) AS order_id,
           CASE WHEN a.order_id IS NULL THEN 'inserted' WHEN b.order_id IS NULL THEN 'deleted' ELSE 'updated' END AS change_type,
           coalesce(b.version, a.version) AS version, coalesce(b.committed_at, a.committed_at) AS committed_at,
           coalesce(b.customer_id, a.customer_id) AS customer_id, coalesce(b.status, a.status) AS status,
           round(coalesce(b.amount, a.amount), 2) AS amount
    FROM a FULL OUTER JOIN b ON a.order_id = b.order_id
    WHERE a.order_id IS NULL OR b.order_id IS NULL
       OR a.version IS DISTINCT FROM b.version OR a.status IS DISTINCT FROM b.status
       OR a.amount IS DISTINCT FROM b.amount OR a.customer_id IS DISTINCT FROM b.customer_id
       OR a.committed_at IS DISTINCT FROM b.committed_at""")
def _t8(spark, d):
    c = changes_df(spark, d)
    a = tbl.as_of(c, ["order_id"], version=60)
    b = tbl.as_of(c, ["order_id"], version=61)
    return rounded(tbl.diff_versions(a, b, ["order_id"]), ["amount"])


@register("t9_retention", """
    WITH a AS (SELECT *, CASE tenant_id WHEN 'tenant_a' THEN 'raw' WHEN 'tenant_b' THEN 'staging' ELSE 'curated' END AS layer
               FROM audit_queries),
    p AS (SELECT * FROM (VALUES ('raw', 90), ('staging', 30), ('curated', NULL), ('quarantine', 30), ('audit', 2555))
          AS t(layer, retention_days))
    SELECT query_id, layer, "timestamp", ranger_decision FROM a LEFT JOIN p USING (layer)
    WHERE p.retention_days IS NULL
       OR "timestamp" >= TIMESTAMP '2024-02-15 00:00:00' - to_days(CAST(p.retention_days AS INTEGER))
       OR ranger_decision = 'DENY'""")
def _t9(spark, d):
    a = src.audit_queries(spark, d).withColumn(
        "layer", F.when(F.col("tenant_id") == "tenant_a", "raw").when(F.col("tenant_id") == "tenant_b", "staging")
        .otherwise("curated")).withColumn("hold", F.col("ranger_decision") == "DENY")
    kept = tbl.apply_retention(a, "timestamp", "layer", tbl.retention_policy(spark), "2024-02-15 00:00:00", "hold")
    return kept.select("query_id", "layer", "timestamp", "ranger_decision")


@register("a14_maintenance_report", f"""
    WITH s AS ({SNAPSHOTS_SQL}),
    e AS (SELECT table_name FROM s QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY committed_at DESC, snapshot_id DESC) > 5
          AND committed_at < TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 7 DAY),
    f AS ({FILES_SQL}),
    o AS (SELECT * FROM f WHERE (size_bytes / 120) % 7 = 0 AND modified_at < TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 3 DAY),
    c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY partition) AS k FROM f) WHERE k >= 10)
    SELECT table_name, 'expire_snapshots' AS action, count(*) AS n FROM e GROUP BY table_name
    UNION ALL SELECT regexp_extract(path, '^([^/]+)/', 1), 'remove_orphan_files', count(*) FROM o GROUP BY 1
    UNION ALL SELECT regexp_extract(path, '^([^/]+)/', 1), 'rewrite_data_files', count(*) FROM c GROUP BY 1""")
def _a14(spark, d):
    now = "2001-12-01 00:00:00"
    exp = tbl.expirable(tbl.snapshot_log(changes_df(spark, d)), now, 7, 5)
    f = files_df(spark, d)
    orph = tbl.orphan_files(f, f.filter((F.col("size_bytes") / 120) % 7 != 0), now, 3)
    plan = tbl.compaction_plan(f, 10, 50_000)
    return tbl.maintenance_report(exp, orph, plan)


# ---------------------------------------------------------------------------
# Step 3: data quality
# ---------------------------------------------------------------------------

from lakeweave.operators import quality as qa  # noqa: E402
from lakeweave.operators import suites as S  # noqa: E402
from lakeweave.plans.quality_sql import row_failures_sql, suite_sql  # noqa: E402

RAW_EVENTS_COLS = ["event_id", "event_timestamp", "source_system", "ingestion_timestamp", "payload"]
STG_ASSET_COLS = ["order_id", "customer_id", "order_date", "status", "total_amount_usd", "currency",
                  "is_completed", "updated_at", "_ingested_at", "order_amount", "_dbt_source_relation"]
MART_COLS = ["customer_id", "total_revenue", "order_count", "first_order_date", "last_order_date", "region", "email"]
STG_ASSET_SQL = "SELECT *, total_amount_usd AS order_amount, 'stg_orders' AS _dbt_source_relation FROM stg_orders"
MART_SQL = """
    SELECT a.customer_id, a.total_revenue, a.order_count, a.first_order_date, a.last_order_date, cr.region, cr.email
    FROM (SELECT customer_id, sum(total_amount_usd) AS total_revenue, count(*) AS order_count,
                 min(order_date) AS first_order_date, max(order_date) AS last_order_date
          FROM fct_orders GROUP BY customer_id) a
    LEFT JOIN (""" + CUSTOMER_REGIONS_SQL + """) cr ON a.customer_id = cr.customer_id"""


def stg_asset(spark, d):
    """The staging suite bound to stg_orders (FIXTURES.md §2, D14)."""
    return stg_orders_df(spark, d).withColumn("order_amount", F.col("total_amount_usd")) \
                                  .withColumn("_dbt_source_relation", F.lit("stg_orders"))


def mart_asset(spark, d):
    return mdl.customer_mart(fct_df(spark, d), customer_regions(spark, d))


def _qround(df):
    # observed values are count ratios: identical IEEE results in both engines
    return df


def _round_obs(sql: str) -> str:
    return sql


RAW_SUITE_SQL = suite_sql("SELECT * FROM raw_events", RAW_EVENTS_COLS, [], S.RAW_LAYER, "raw_layer")
STG_SUITE_SQL = suite_sql(STG_ASSET_SQL, STG_ASSET_COLS, ["total_amount_usd", "order_amount"], S.STAGING_LAYER,
                          "staging_layer")
MART_SUITE_SQL = suite_sql(MART_SQL, MART_COLS, ["total_revenue", "order_count"], S.CURATED_LAYER, "curated_layer")


@register("q_raw_layer_suite", _round_obs(RAW_SUITE_SQL))
def _qraw(spark, d):
    return _qround(qa.validate(src.raw_events(spark, d), S.RAW_LAYER, "raw_layer"))


@register("q_staging_layer_suite", _round_obs(STG_SUITE_SQL))
def _qstg(spark, d):
    return _qround(qa.validate(stg_asset(spark, d), S.STAGING_LAYER, "staging_layer"))


@register("q_curated_layer_suite", _round_obs(MART_SUITE_SQL))
def _qcur(spark, d):
    return _qround(qa.validate(mart_asset(spark, d), S.CURATED_LAYER, "curated_layer"))


_MODEL_SQL = {"stg_customers": ("SELECT * FROM stg_customers", ["customer_id", "email"]),
              "stg_orders": ("SELECT * FROM stg_orders", ["order_id", "customer_id", "status"]),
              "rpt_revenue_by_region": ("SELECT country FROM fct_orders GROUP BY country", ["country"])}


@register("q12_model_tests", _round_obs("\nUNION ALL\n".join(
    f"SELECT * FROM ({suite_sql(sql, cols, [], S.MODEL_TESTS[m], m)})" for m, (sql, cols) in _MODEL_SQL.items())))
def _q12(spark, d):
    models = {"stg_customers": stg_customers_df(spark, d), "stg_orders": stg_orders_df(spark, d),
              "rpt_revenue_by_region": mdl.rpt_revenue_by_region(fct_df(spark, d), src.RUN_TS)}
    out = None
    for m, df in models.items():
        r = qa.validate(df, S.MODEL_TESTS[m], m)
        out = r if out is None else out.unionByName(r)
    return _qround(out)


def _table_test_sql(table: str, body: str) -> list[str]:
    out = []
    for column, tests in S.TABLE_TESTS[table].items():
        for t in tests:
            kind = t if isinstance(t, str) else "accepted_values"
            if kind == "not_null":
                fails = f"SELECT count(*) FROM {body} WHERE {column} IS NULL"
            elif kind == "unique":
                fails = f"SELECT count(*) FROM (SELECT {column} FROM {body} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"
            else:
                fails = f"SELECT count(DISTINCT {column}) FROM {body} WHERE {column} NOT IN ({', '.join(repr(v) for v in t)})"
            out.append(f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS test, ({fails}) AS failures, "
                       f"(SELECT count(*) FROM {body}) AS table_rows")
    return out


_RPT_SQL = """(SELECT country, count(*) AS total_orders, count(CASE WHEN is_completed THEN 1 END) AS completed_orders,
    sum(CASE WHEN is_completed THEN total_amount_usd ELSE 0 END) AS total_revenue_usd, 1.0 AS completion_rate FROM fct_orders GROUP BY country)"""
_RAW_DOCS_SQL = "(SELECT 'run' AS run_id, doc_id AS source_key, text AS extracted_text, 1 AS _ingested_at FROM documents)"
_TABLE_BODIES = {t: t for t in S.TABLE_TESTS} | {"rpt_revenue_by_region": _RPT_SQL, "raw_documents": _RAW_DOCS_SQL}


@register("q12_table_tests", "WITH r AS (" + "\nUNION ALL ".join(x for t, b in _TABLE_BODIES.items() for x in _table_test_sql(t, b)) + """)
    SELECT table_name, column_name, test, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status, table_rows FROM r""")
def _q12t(spark, d):
    from lakeweave.sources import documents as dl

    fct = materialize(fct_df(spark, d), "fct")
    models = {"raw_customers": src.raw_customers(spark, d), "raw_orders": src.raw_orders(spark, d), "raw_products": src.raw_products(spark, d),
              "raw_documents": dl.raw_documents(spark, d), "stg_customers": stg_customers_df(spark, d), "stg_orders": stg_orders_df(spark, d),
              "stg_products": mdl.stg_products(src.raw_products(spark, d)), "dim_customers": dim_df(spark, d), "fct_orders": fct,
              "rpt_revenue_by_region": mdl.rpt_revenue_by_region(fct, src.RUN_TS)}
    return qa.table_tests(models, S.TABLE_TESTS)


@register("q13_revenue_violations", """
    SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 40 = 0 THEN 0.0 ELSE -total_amount_usd END AS total_amount_usd
    FROM fct_orders WHERE is_completed AND CAST(order_id AS BIGINT) % 20 = 0 AND (CAST(order_id AS BIGINT) % 40 = 0 OR total_amount_usd >= 0)""")
def _q13v(spark, d):
    """The test over facts of which every twentieth has a zero or negated amount."""
    n = F.col("order_id").cast("bigint")
    f = fct_df(spark, d).withColumn("total_amount_usd", F.when(n % 40 == 0, F.lit(0.0)).when(n % 20 == 0, -F.col("total_amount_usd"))
                                    .otherwise(F.col("total_amount_usd")))
    return mdl.revenue_not_positive(f)


@register("q11_pair_rules", """
    WITH r AS (SELECT count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS e, count(*) FILTER (WHERE NOT (o_orderkey > o_custkey)) AS strict,
                      count(*) FILTER (WHERE NOT (o_orderkey >= o_custkey)) AS lax FROM orders)
    SELECT 'pairs' AS suite, 0 AS rule_index, 'expect_column_pair_values_A_to_be_greater_than_B' AS expectation, 'o_orderkey,o_custkey' AS column_name,
           e AS element_count, strict AS unexpected_count, strict / e AS observed_value, 1 - strict / e >= 0.9999 AS success FROM r
    UNION ALL
    SELECT 'pairs', 1, 'expect_column_pair_values_A_to_be_greater_than_B', 'o_orderkey,o_custkey', e, lax, lax / e, 1 - lax / e >= 0.5 FROM r""")
def _q11p(spark, d):
    pair = {"column_A": "o_orderkey", "column_B": "o_custkey", "ignore_row_if": "either_value_is_missing"}
    suite = [S.rule("expect_column_pair_values_A_to_be_greater_than_B", **pair, mostly=0.9999),
             S.rule("expect_column_pair_values_A_to_be_greater_than_B", **pair, or_equal=True, mostly=0.5)]
    return qa.validate(src.read_table(spark, d, "orders"), suite, "pairs")


@register("q14_source_freshness", """
    SELECT 'raw_orders' AS source, max(_ingested_at) AS max_loaded_at,
           date_diff('microsecond', max(_ingested_at), TIMESTAMP '2001-08-02 12:00:00') / 3.6e9 AS age_hours,
           CASE WHEN max(_ingested_at) IS NULL OR date_diff('microsecond', max(_ingested_at), TIMESTAMP '2001-08-02 12:00:00') / 3.6e9 > 24 THEN 'error'
                WHEN date_diff('microsecond', max(_ingested_at), TIMESTAMP '2001-08-02 12:00:00') / 3.6e9 > 6 THEN 'warn' ELSE 'pass' END AS status
    FROM raw_orders""")
def _q14(spark, d):
    r = qa.freshness(src.raw_orders(spark, d), "_ingested_at", "2001-08-02 12:00:00", 6, 24, "raw_orders")
    return r


_ASSET_SQL = [("raw_events", RAW_SUITE_SQL), ("stg_orders", STG_SUITE_SQL), ("customer_mart", MART_SUITE_SQL)]
CHECKPOINT_SQL = "WITH r AS (" + "\nUNION ALL\n".join(
    f"SELECT *, '{a}' AS asset FROM ({s})" for a, s in _ASSET_SQL) + """)
    SELECT *,
           bool_and(success) OVER (PARTITION BY asset) AS asset_success,
           CASE WHEN bool_and(success) OVER (PARTITION BY asset) THEN 'pass'
                WHEN suite = 'raw_layer' THEN 'fail_pipeline' WHEN suite = 'staging_layer' THEN 'quarantine'
                ELSE 'block_promotion_and_page' END AS action
    FROM r"""


def checkpoint_df(spark, d):
    assets = [("raw_events", src.raw_events(spark, d), "raw_layer", S.RAW_LAYER),
              ("stg_orders", stg_asset(spark, d), "staging_layer", S.STAGING_LAYER),
              ("customer_mart", mart_asset(spark, d), "curated_layer", S.CURATED_LAYER)]
    return qa.checkpoint(assets, S.ON_FAILURE)


@register("q15_checkpoint_staging", CHECKPOINT_SQL)
def _q15(spark, d):
    return _qround(checkpoint_df(spark, d))


@register("a13_quality_summary", """
    SELECT suite, asset, count(*) AS evaluated, count(CASE WHEN success THEN 1 END) AS successful,
           count(CASE WHEN NOT success THEN 1 END) AS unsuccessful,
           count(CASE WHEN success THEN 1 END) / count(*) AS pass_rate
    FROM (""" + CHECKPOINT_SQL + ") GROUP BY suite, asset")
def _a13(spark, d):
    return qa.quality_summary(checkpoint_df(spark, d), ["suite", "asset"])


_S13_FAILS = row_failures_sql(S.STAGING_LAYER, STG_ASSET_COLS, ["total_amount_usd", "order_amount"])
S13_SQL = f"""
    WITH a AS ({STG_ASSET_SQL}),
    c AS (SELECT order_id AS k, count(*) AS cnt FROM a GROUP BY order_id),
    f AS (SELECT a.order_id, list_filter([{', '.join(f"CASE WHEN coalesce({cond}, FALSE) THEN '{lab}' END" for lab, cond in _S13_FAILS)},
                                          CASE WHEN c.cnt > 1 THEN 'duplicate:order_id' END], lambda x: x IS NOT NULL) AS reasons
          FROM a LEFT JOIN c ON a.order_id = c.k)
    SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM f) GROUP BY reason
    UNION ALL SELECT 'good', count(*) FROM f WHERE len(reasons) = 0"""


@register("q15_checkpoint_actions", f"""
    WITH c AS (SELECT DISTINCT asset, action FROM ({CHECKPOINT_SQL})),
    s AS ({S13_SQL}),
    n AS (SELECT 'raw_events' AS asset, (SELECT count(*) FROM events) AS n UNION ALL SELECT 'stg_orders', (SELECT count(*) FROM stg_orders)
          UNION ALL SELECT 'customer_mart', (SELECT count(DISTINCT customer_id) FROM fct_orders)),
    g AS (SELECT n AS good FROM s WHERE reason = 'good'),
    f AS (SELECT bool_or(action = 'fail_pipeline') AS stop FROM c)
    SELECT c.asset, CASE WHEN f.stop AND c.asset <> 'raw_events' THEN 'not_run' ELSE c.action END AS action,
           CASE WHEN NOT (f.stop AND c.asset <> 'raw_events') THEN n.n END AS input_rows,
           CASE WHEN f.stop AND c.asset <> 'raw_events' THEN NULL WHEN c.action = 'pass' THEN n.n WHEN c.action = 'quarantine' THEN g.good ELSE 0 END AS promoted_rows,
           CASE WHEN f.stop AND c.asset <> 'raw_events' THEN NULL WHEN c.action = 'quarantine' THEN n.n - g.good ELSE 0 END AS quarantined_rows
    FROM c JOIN n USING (asset), g, f""")
def _q15a(spark, d):
    assets = [("raw_events", src.raw_events(spark, d), "raw_layer", S.RAW_LAYER), ("stg_orders", stg_asset(spark, d), "staging_layer", S.STAGING_LAYER),
              ("customer_mart", mart_asset(spark, d), "curated_layer", S.CURATED_LAYER)]
    return qa.carry_out(assets, S.ON_FAILURE, _folder(spark, "checkpoint"), {"stg_orders": ["order_id"]})


@register("s13_quarantine_split", S13_SQL)
def _s13(spark, d):
    good, bad = qa.split_quarantine(stg_asset(spark, d), S.STAGING_LAYER, unique_keys=["order_id"])
    reasons = bad.select(F.explode("fail_reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))
    return reasons.unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("reason"), "n"))


def _sqlstr(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


PII_SQL = ("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_sqlstr(p)})) AS {k}_count"
                                          for k, p in qa.PII_PATTERNS.items())
           + ", " + " OR ".join(f"regexp_matches(text, {_sqlstr(p)})" for p in qa.PII_PATTERNS.values())
           + " AS has_pii FROM documents")


@register("q16_pii_scan_documents", PII_SQL)
def _q16(spark, d):
    docs = src.read_table(spark, d, "documents").select("doc_id", "text")
    return qa.pii_scan(docs, "text").drop("text")


@register("q17_completeness", _round_obs(suite_sql(
    "SELECT * FROM raw_customers", ["customer_id", "email", "first_name", "last_name", "country", "created_at",
                                    "updated_at", "_ingested_at"], [],
    [S.rule("expect_column_values_to_not_be_null", column=c, mostly=0.95) for c in ("customer_id", "email", "country")],
    "completeness")))
def _q17(spark, d):
    rules = [S.rule("expect_column_values_to_not_be_null", column=c, mostly=0.95)
             for c in ("customer_id", "email", "country")]
    return _qround(qa.validate(src.raw_customers(spark, d), rules, "completeness"))


def curated_customers(spark, d):
    """curated.customers: generator formulas over c_custkey, region = r_name."""
    c = src.read_table(spark, d, "customer")
    keys = c.join(src._nation_names(spark, d), c.c_nationkey == F.col("n_nationkey"), "left") \
            .select(F.col("c_custkey").alias("seq"), "c_name", F.col("r_name").alias("region"))
    return gen.generate_customers(keys)


_CUR_STRING_COLS = ["email", "phone", "ssn", "loyalty_tier", "c_name", "region"]
CURATED_CUSTOMERS_SQL = """
    SELECT c_custkey AS customer_id,
           'user' || CAST(c_custkey AS VARCHAR) || '@example' || CAST(c_custkey % 5 + 1 AS VARCHAR) || '.com' AS email,
           '+1-' || CAST(200 + c_custkey % 800 AS VARCHAR) || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
           substr(s9, 1, 3) || '-' || substr(s9, 4, 2) || '-' || substr(s9, 6, 4) AS ssn,
           CAST(DATE '1970-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS DATE) AS date_of_birth,
           CAST(DATE '2018-01-01' + CAST(c_custkey % 2190 AS INTEGER) AS DATE) AS signup_date,
           (['bronze', 'silver', 'gold', 'platinum'])[CAST(c_custkey % 4 + 1 AS INTEGER)] AS loyalty_tier,
           CAST(500 + (c_custkey * 137) % 99500 AS DECIMAL(12,2)) AS annual_revenue,
           c_name, r_name AS region
    FROM (SELECT *, CASE WHEN length(CAST(100000000 + c_custkey % 900000000 AS VARCHAR)) >= 9
                         THEN CAST(100000000 + c_custkey % 900000000 AS VARCHAR)
                         ELSE lpad(CAST(100000000 + c_custkey % 900000000 AS VARCHAR), 9, '0') END AS s9
          FROM customer LEFT JOIN nation_names ON c_nationkey = n_nationkey)"""


def _tag_sql() -> str:
    import re as _re
    cols = ["customer_id", "email", "phone", "ssn", "date_of_birth", "signup_date", "loyalty_tier",
            "annual_revenue", "c_name", "region"]
    names = []
    for c in cols:
        for tag, rx in qa.PII_NAME_PATTERNS.items():
            if _re.search(rx.replace("(?i)", ""), c, flags=_re.IGNORECASE):
                names.append(f"SELECT '{c}' AS column_name, '{tag}' AS tag, 'name' AS source, CAST(NULL AS DOUBLE) AS match_rate")
                break
    rates = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'PII_{k.upper()}' AS tag, 'content' AS source, "
        f"avg(CASE WHEN regexp_matches({c}, {_sqlstr(p)}) THEN 1.0 ELSE 0.0 END) AS match_rate FROM cc"
        for c in _CUR_STRING_COLS for k, p in qa.PII_PATTERNS.items())
    return (f"WITH cc AS ({CURATED_CUSTOMERS_SQL}) " + " UNION ALL ".join(names)
            + f" UNION ALL SELECT * FROM ({rates}) WHERE match_rate >= 0.05")


@register("q18_tag_pii_columns", _tag_sql())
def _q18(spark, d):
    return qa.tag_pii_columns(curated_customers(spark, d), 0.05)


@register("a12_profile", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
              CASE WHEN count(*) > 0 THEN CAST(count(*) - count({c}) AS DOUBLE) / count(*) END AS null_fraction,
              count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value,
              CAST(max({c}) AS VARCHAR) AS max_value, CAST(NULL AS DOUBLE) AS mean_value, count(*) AS row_count
       FROM fct_orders""" for c in ["order_id", "customer_id", "status", "currency", "order_date", "country"]))
def _a12(spark, d):
    p = qa.profile(fct_df(spark, d), ["order_id", "customer_id", "status", "currency", "order_date", "country"],
                   exact=True)
    return p


@register("w5_consecutive_failures", """
    WITH runs AS (SELECT event_type AS suite, CAST(ts AS DATE) AS run_ts, avg(CASE WHEN value <= 45 THEN 1.0 ELSE 0.0 END) AS pass_rate
                  FROM events GROUP BY 1, 2)
    SELECT suite, run_ts, pass_rate,
           count(*) OVER w = 3 AND max(pass_rate) OVER w < 0.95 AS alert
    FROM runs WINDOW w AS (PARTITION BY suite ORDER BY run_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _w5(spark, d):
    e = src.read_table(spark, d, "events")
    runs = e.groupBy(F.col("event_type").alias("suite"), F.to_date("ts").alias("run_ts")).agg(
        F.avg(F.when(F.col("value") <= 45, 1.0).otherwise(0.0)).alias("pass_rate"))
    return qa.consecutive_failures(runs, 3, 0.95)


# ---------------------------------------------------------------------------
# Step 4: governance - masks, row filters, access decisions, privacy, lineage
# ---------------------------------------------------------------------------

from lakeweave.operators import governance as gov  # noqa: E402
from lakeweave.operators import lineage as lin  # noqa: E402

CUST_TABLE = "lakehouse.curated.customers"
ANALYST = gov.Principal("ana", ("data-analysts",), {"ranger.assigned_region": "AMERICA"}, "tenant_b")
STEWARD = gov.Principal("sam", ("data-stewards",))
ENGINEER = gov.Principal("eve", ("data-engineers",))


def _first4(c):
    return f"(substr({c}, 1, 4) || repeat('x', greatest(length({c}) - 4, 0)))"


@register("g1_mask_columns_analyst", f"""
    SELECT customer_id, sha256(CAST(email AS VARCHAR)) AS email, CAST(NULL AS VARCHAR) AS phone,
           CAST(NULL AS VARCHAR) AS ssn, region FROM ({CURATED_CUSTOMERS_SQL})""")
def _g1a(spark, d):
    return gov.mask_columns(curated_customers(spark, d), CUST_TABLE, ANALYST) \
              .select("customer_id", "email", "phone", "ssn", "region")


@register("g1_mask_columns_steward", f"""
    SELECT customer_id, {_first4('email')} AS email, {_first4('phone')} AS phone, CAST(NULL AS VARCHAR) AS ssn, region
    FROM ({CURATED_CUSTOMERS_SQL})""")
def _g1s(spark, d):
    return gov.mask_columns(curated_customers(spark, d), CUST_TABLE, STEWARD) \
              .select("customer_id", "email", "phone", "ssn", "region")


@register("g2_row_filter_analyst", f"""
    SELECT customer_id, region FROM ({CURATED_CUSTOMERS_SQL}) WHERE region = 'AMERICA'""")
def _g2(spark, d):
    return gov.row_filter(curated_customers(spark, d), CUST_TABLE, ANALYST).select("customer_id", "region")


@register("g3_tenant_filter", "SELECT query_id, tenant_id FROM audit_queries WHERE tenant_id = 'tenant_b'")
def _g3(spark, d):
    return gov.tenant_filter(src.audit_queries(spark, d), ANALYST).select("query_id", "tenant_id")


@register("g5_secure_select_analyst", f"""
    SELECT customer_id, sha256(CAST(email AS VARCHAR)) AS email, CAST(NULL AS VARCHAR) AS phone,
           CAST(NULL AS VARCHAR) AS ssn, region, loyalty_tier
    FROM ({CURATED_CUSTOMERS_SQL}) WHERE region = 'AMERICA'""")
def _g5(spark, d):
    return gov.secure_select(curated_customers(spark, d), CUST_TABLE, ANALYST) \
              .select("customer_id", "email", "phone", "ssn", "region", "loyalty_tier")


def access_requests(spark, d):
    """One request per (query, table): the schema comes from the table name,
    the principal's groups from the user id, the access from the event."""
    a = src.audit_queries(spark, d)
    uid = F.regexp_extract("username", r"(\d+)$", 1).cast("bigint")
    g = (F.when(uid % 4 == 0, "data-analysts").when(uid % 4 == 1, "data-engineers")
         .when(uid % 4 == 2, "data-stewards").otherwise("platform-admins"))
    groups = F.when(uid % 10 == 0, F.array(g, F.lit("data-stewards"))).otherwise(F.array(g))
    t = a.select("query_id", "username", groups.alias("groups"), "event_type",
                 F.explode("tables_accessed").alias("fq"))
    parts = F.split("fq", r"\.")
    sch = F.element_at(parts, 2)
    return t.select("query_id", "username", "groups", F.lit("lakehouse").alias("catalog"),
                    F.when(sch == "marts", "curated").otherwise(sch).alias("schema"),
                    F.element_at(parts, 3).alias("table"),
                    F.when(F.col("event_type") == "purchase", "insert").otherwise("select").alias("access"))


ACCESS_REQUESTS_SQL = """
    SELECT query_id, username, groups, 'lakehouse' AS catalog,
           CASE WHEN split_part(fq, '.', 2) = 'marts' THEN 'curated' ELSE split_part(fq, '.', 2) END AS schema,
           split_part(fq, '.', 3) AS "table", CASE WHEN event_type = 'purchase' THEN 'insert' ELSE 'select' END AS access
    FROM (SELECT query_id, username, event_type, unnest(tables_accessed) AS fq,
                 CASE WHEN uid % 10 = 0 THEN [g, 'data-stewards'] ELSE [g] END AS groups
          FROM (SELECT *, CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) AS uid,
                       CASE CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) % 4 WHEN 0 THEN 'data-analysts'
                            WHEN 1 THEN 'data-engineers' WHEN 2 THEN 'data-stewards' ELSE 'platform-admins' END AS g
                FROM audit_queries))"""


def _access_decision_sql() -> str:
    def cond(rule):
        kind, grp, cat, sch, tbl, accesses, not_in = rule
        parts = [f"list_contains(groups, '{grp}')", "access IN (" + ", ".join(f"'{a}'" for a in accesses) + ")"]
        for pat, colname in ((cat, "catalog"), (sch, "schema"), (tbl, '"table"')):
            if pat != "*":
                parts.append(f"{colname} = '{pat}'")
        if not_in:
            parts.append("(catalog || '/' || schema) NOT IN (" + ", ".join(f"'{x}'" for x in not_in) + ")")
        return "(" + " AND ".join(parts) + ")"
    deny = " OR ".join(cond(r) for r in gov.ACCESS_RULES if r[0] == "deny") or "FALSE"
    allow = " OR ".join(cond(r) for r in gov.ACCESS_RULES if r[0] == "allow") or "FALSE"
    return f"CASE WHEN {deny} THEN 'DENY' WHEN {allow} THEN 'ALLOW' ELSE 'DENY' END"


@register("g4_evaluate_access", f"SELECT *, {_access_decision_sql()} AS decision FROM ({ACCESS_REQUESTS_SQL})")
def _g4(spark, d):
    return gov.evaluate_access(access_requests(spark, d), gov.rules_frame(spark))


# Privacy requests: the customers with a negative account balance ask for
# erasure / anonymisation / an access report.
SUBJECTS_SQL = f"SELECT 'CUST-' || {zpad_sql('c_custkey', 6)} AS subject_id FROM customer WHERE c_acctbal < 0"


def subjects_df(spark, d):
    c = src.read_table(spark, d, "customer").filter(F.col("c_acctbal") < 0)
    return c.select(F.concat(F.lit("CUST-"), fn.zpad(F.col("c_custkey"), 6)).alias("subject_id"))


def _erasure(spark, d):
    tables = {"fct_orders": fct_df(spark, d), "stg_customers": stg_customers_df(spark, d)}
    keys = {"fct_orders": "customer_id", "stg_customers": "customer_id"}
    return gov.erase_and_verify({n: materialize(t, n) for n, t in tables.items()}, keys, subjects_df(spark, d))[1]


ERASURE_SQL = f"""
    WITH s AS ({SUBJECTS_SQL}),
    r AS (SELECT s.subject_id, 'fct_orders' AS table_name, count(f.order_id) AS rows_removed, 0 AS rows_left
          FROM s LEFT JOIN fct_orders f ON f.customer_id = s.subject_id GROUP BY s.subject_id
          UNION ALL
          SELECT s.subject_id, 'stg_customers', count(c.customer_id), 0
          FROM s LEFT JOIN stg_customers c ON c.customer_id = s.subject_id GROUP BY s.subject_id)"""


@register("g13_erase_subjects", ERASURE_SQL + " SELECT subject_id, table_name, rows_removed, CAST(rows_left AS BIGINT) AS rows_left FROM r")
def _g13(spark, d):
    return _erasure(spark, d)


@register("g16_erasure_certificate", ERASURE_SQL + """
    SELECT subject_id, list_sort(list(table_name) FILTER (WHERE rows_removed > 0)) AS tables_affected,
           sum(rows_removed) AS rows_erased, sum(rows_left) = 0 AS verified,
           TIMESTAMP '2024-02-01 00:00:00' AS completed_at,
           sha256(subject_id || '|' || '2024-02-01 00:00:00') AS certificate_id
    FROM r GROUP BY subject_id""")
def _g16(spark, d):
    return gov.erasure_certificate(_erasure(spark, d), "2024-02-01 00:00:00")


@register("g14_redact_audit", f"""
    SELECT query_id, username,
           CASE WHEN CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) % 10 = 0
                THEN regexp_replace(sql_text, '{fn.EMAIL_RE}', '[REDACTED]', 'g') ELSE sql_text END AS sql_text
    FROM audit_queries""")
def _g14(spark, d):
    a = src.audit_queries(spark, d)
    subj = a.select("username").distinct().filter(
        F.regexp_extract("username", r"(\d+)$", 1).cast("bigint") % 10 == 0)
    return gov.redact(a, "sql_text", [fn.EMAIL_RE], subj, "username").select("query_id", "username", "sql_text")


_TEXT_OF_USERS = """sql_text || ' -- by ' || upper(username) || ' (' || user_sub || '), not ' || username || 'x, from ' || source_ip || ':443'"""


@register("g14_redact_subject_values", f"""
    WITH t AS (SELECT query_id, username, user_sub, {_TEXT_OF_USERS} AS text FROM audit_queries),
    v AS (SELECT DISTINCT unnest([username, user_sub, username || '@example.com']) AS value FROM audit_queries
          WHERE CAST(substr(username, 5) AS BIGINT) % 10 = 0),
    p AS (SELECT '(?i)\\b(' || string_agg(replace(value, '.', '\\.'), '|' ORDER BY length(value) DESC, value) || ')\\b' AS pattern FROM v)
    SELECT query_id, regexp_replace(text, pattern, '[REDACTED]', 'g') AS text,
           len(regexp_extract_all(text, pattern)) AS redactions FROM t, p""")
def _g14v(spark, d):
    from lakeweave.operators import redaction as red

    a = src.audit_queries(spark, d)
    texts = a.select("query_id", F.expr(_TEXT_OF_USERS).alias("text"))
    users = a.select("username", "user_sub", F.concat("username", F.lit("@example.com")).alias("email")).distinct()
    subjects = users.filter(F.substring("username", 5, 20).cast("bigint") % 10 == 0)
    values = red.subject_values(subjects, "username", {"users": (users, "username", ["user_sub", "email"])})
    return red.redact_values(texts, "text", values, count="redactions")


@register("g15_anonymize", f"""
    SELECT customer_id,
           CASE WHEN customer_id IN (SELECT subject_id FROM ({SUBJECTS_SQL})) THEN 'anon-' || md5(customer_id) ELSE email END AS email,
           CASE WHEN customer_id IN (SELECT subject_id FROM ({SUBJECTS_SQL})) THEN 'anon-' || md5(customer_id) ELSE full_name END AS full_name,
           country
    FROM stg_customers""")
def _g15(spark, d):
    a = gov.anonymize(stg_customers_df(spark, d), subjects_df(spark, d), "customer_id", ["email", "full_name"])
    return a.select("customer_id", "email", "full_name", "country")


@register("g17_rectify_changes", """
    SELECT customer_id, 'email' AS column_name, email AS old_value, 'fixed.' || email AS new_value,
           TIMESTAMP '2024-02-01 00:00:00' AS changed_at
    FROM stg_customers WHERE CAST(substr(customer_id, 6) AS BIGINT) % 50 = 1""")
def _g17(spark, d):
    stg = stg_customers_df(spark, d)
    corr = stg.filter(F.substring("customer_id", 6, 20).cast("bigint") % 50 == 1) \
              .select("customer_id", F.concat(F.lit("fixed."), F.col("email")).alias("email"))
    _, changes = gov.rectify(stg, corr, "customer_id", "2024-02-01 00:00:00")
    return changes


@register("g17_rectified_table", """
    SELECT customer_id, CASE WHEN CAST(substr(customer_id, 6) AS BIGINT) % 50 = 1 THEN 'fixed.' || email ELSE email END AS email,
           full_name, country FROM stg_customers""")
def _g17t(spark, d):
    stg = stg_customers_df(spark, d)
    corr = stg.filter(F.substring("customer_id", 6, 20).cast("bigint") % 50 == 1) \
              .select("customer_id", F.concat(F.lit("fixed."), F.col("email")).alias("email"))
    updated, _ = gov.rectify(stg, corr, "customer_id", "2024-02-01 00:00:00")
    return materialize(updated, "rectified").select("customer_id", "email", "full_name", "country")


@register("g18_subject_report_fields", f"""
    WITH s AS ({SUBJECTS_SQL})
    SELECT s.subject_id, 'fct_orders' AS table_name, CAST(f.order_id AS VARCHAR) AS order_id, f.status, f.country, NULL AS email
    FROM s JOIN fct_orders f ON f.customer_id = s.subject_id
    UNION ALL
    SELECT s.subject_id, 'stg_customers', NULL, NULL, c.country, c.email FROM s JOIN stg_customers c ON c.customer_id = s.subject_id""")
def _g18f(spark, d):
    r = _g18(spark, d)
    record = next(c for c in r.columns if c not in ("subject_id", "table_name"))
    return r.select("subject_id", "table_name", *[F.get_json_object(record, f"$.{c}").alias(c) for c in ("order_id", "status", "country", "email")])


@register("g18_subject_report")
def _g18(spark, d):
    tables = {"fct_orders": fct_df(spark, d), "stg_customers": stg_customers_df(spark, d)}
    return gov.subject_report(tables, {"fct_orders": "customer_id", "stg_customers": "customer_id"},
                              subjects_df(spark, d))


@register("g19_lineage_downstream", """
    WITH RECURSIVE e AS (
        SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS child, 'customer:' || CAST(o_custkey AS VARCHAR) AS parent FROM orders
        UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
        UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'region:' || CAST(n_regionkey AS VARCHAR) FROM nation),
    walk(node, depth) AS (
        SELECT 'region:1', 0
        UNION ALL SELECT e.child, walk.depth + 1 FROM walk JOIN e ON e.parent = walk.node WHERE walk.depth < 50)
    SELECT node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY node""")
def _g19(spark, d):
    edges = lin.key_lineage_edges(src.read_table(spark, d, "orders"), src.read_table(spark, d, "customer"),
                                  src.read_table(spark, d, "nation"))
    start = spark.range(1).select(F.lit("region:1").alias("node"))
    return lin.lineage(edges, start, "downstream").select("node", F.col("depth"))


@register("g19_lineage_doubling", """
    WITH n AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth FROM orders)
    SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS node, CAST(depth AS INTEGER) AS depth FROM n WHERE depth > 0""")
def _g19d(spark, d):
    o = src.read_table(spark, d, "orders")
    name = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = o.select(name.alias("child"), F.lag(name).over(w).alias("parent"))
    return lin.lineage_doubling(e.filter("parent IS NOT NULL"), e.filter("parent IS NULL").select(F.col("child").alias("node")), "downstream")


@register("g20_mask_by_tags", f"""
    SELECT customer_id, email, phone, CAST(NULL AS VARCHAR) AS ssn, CAST(NULL AS DATE) AS date_of_birth, region
    FROM ({CURATED_CUSTOMERS_SQL})""")
def _g20(spark, d):
    cc = curated_customers(spark, d)
    tags = qa.tag_pii_columns(cc).filter(F.col("tag") == "PII_HIGH")
    return gov.mask_by_tags(cc, tags, "data-analysts").select("customer_id", "email", "phone", "ssn",
                                                              "date_of_birth", "region")


# ---------------------------------------------------------------------------
# Step 5: audit trail and privacy evidence
# ---------------------------------------------------------------------------

from lakeweave.operators import audit as aud  # noqa: E402

RISK_SQL = """
    WITH x AS (SELECT username, unnest(tables_accessed) AS table_name, "timestamp" FROM audit_queries),
    f AS (SELECT username, table_name, min("timestamp") AS fst FROM x GROUP BY ALL),
    y AS (SELECT a.event_id, max(CAST(split_part(t.table_name, '.', 1) <> a.tenant_id AS INT)) AS cross_t,
                 max(CAST(regexp_matches(t.table_name, '\\.customers$') AS INT)) AS pii,
                 max(CAST(f.fst = a."timestamp" AS INT)) AS fst
          FROM audit_queries a, (SELECT event_id, unnest(tables_accessed) AS table_name FROM audit_queries) t, f
          WHERE t.event_id = a.event_id AND f.username = a.username AND f.table_name = t.table_name
          GROUP BY a.event_id)
    SELECT event_id,
           CASE WHEN cross_t = 1 AND pii = 1 THEN 'CRITICAL' WHEN cross_t = 1 THEN 'HIGH'
                WHEN pii = 1 OR fst = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
           list_filter([CASE WHEN cross_t = 1 THEN 'CROSS_TENANT_ACCESS' END, CASE WHEN fst = 1 THEN 'FIRST_TIME_ACCESS' END,
                        CASE WHEN pii = 1 THEN 'PII_ACCESS' END], lambda v: v IS NOT NULL) AS risk_flags
    FROM y"""


@register("g21_flag_risk", RISK_SQL)
def _g21(spark, d):
    return aud.flag_risk(src.audit_queries(spark, d)).select("event_id", "risk_level", "risk_flags")


def normalized_df(spark, d):
    return aud.normalize_events(aud.flag_risk(src.audit_queries(spark, d)), aud.registry_frame(spark))


def _reg_sql(idx: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{row[0]}' THEN '{row[idx]}'" for row in aud.EVENT_REGISTRY) + " END"


@register("g6_normalize_events", f"""
    WITH r AS ({RISK_SQL})
    SELECT a.event_id, a."timestamp" AS ts, {_reg_sql(2)} AS source_system, {_reg_sql(1)} AS event_type,
           CASE WHEN ranger_decision = 'DENY' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome,
           tenant_id, {_reg_sql(3)} AS action_type, tables_accessed[1] AS resource_identifier,
           coalesce(r.risk_level, 'LOW') AS risk_level, r.risk_flags,
           strftime(a."timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso_timestamp
    FROM audit_queries a LEFT JOIN r USING (event_id)""")
def _g6(spark, d):
    n = normalized_df(spark, d)
    return n.select("event_id", "ts", "source_system", F.col("event.event_type").alias("event_type"),
                    F.col("event.outcome").alias("outcome"), F.col("event.actor.tenant_id").alias("tenant_id"),
                    F.col("event.action.type").alias("action_type"),
                    F.col("event.resource.identifier").alias("resource_identifier"),
                    F.col("event.risk.level").alias("risk_level"), F.col("event.risk.flags").alias("risk_flags"),
                    F.col("event.timestamp").alias("iso_timestamp"))


def _raw_lines(spark, d):
    from lakeweave.operators import normalize

    a = src.audit_queries(spark, d).withColumn("number", F.substring("query_id", 3, 20).cast("bigint"))
    return normalize.normalize_raw(normalize.native_lines(a))


_RAW_SQL = """
    a AS (SELECT *, CAST(substr(query_id, 3) AS BIGINT) AS k FROM audit_queries),
    l AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'trino' WHEN event_type = 'signup' THEN 'openbao' ELSE 'ranger' END AS source,
                 split_part(tables_accessed[1], '.', 1) || '.' || split_part(tables_accessed[1], '.', 2) AS db FROM a)"""


@register("g6_normalize_raw", f"""
    WITH {_RAW_SQL}
    SELECT event_id, "timestamp" AS ts, source AS source_system,
           CASE source WHEN 'trino' THEN CASE WHEN k % 23 = 0 THEN 'data.query.rejected' ELSE 'data.query.executed' END
                WHEN 'openbao' THEN ['secret.read', 'secret.write', 'secret.delete'][k % 3 + 1]
                ELSE CASE WHEN ranger_decision = 'DENY' THEN 'data.access.denied' ELSE 'data.access.allowed' END END AS event_type,
           CASE WHEN source = 'openbao' THEN ['READ', 'WRITE', 'DELETE'][k % 3 + 1] ELSE 'READ' END AS action_type,
           CASE WHEN (source = 'trino' AND k % 23 = 0) OR (source = 'openbao' AND k % 19 = 0) OR (source = 'ranger' AND ranger_decision = 'DENY')
                THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome,
           user_sub AS sub, username, tenant_id, source_ip AS ip_address,
           CASE source WHEN 'openbao' THEN 'openbao.secret' ELSE 'iceberg.table' END AS resource_type,
           CASE source WHEN 'openbao' THEN 'secret/' || username ELSE tables_accessed[1] END AS identifier,
           CASE source
             WHEN 'trino' THEN '{{"catalog":"trino","cluster":"' || "cluster" || '","duration_ms":' || duration_ms || ',"query_id":"' || query_id
               || '","query_type":"SELECT","ranger_decisions":[{{"resource":"' || tables_accessed[1] || '","action":"SELECT","decision":"' || ranger_decision
               || '"}}],"rows_returned":' || rows_returned || ',"rows_scanned":' || rows_scanned || ',"schema":"' || db || '","sql_text":"' || sql_text
               || '","sql_text_hash":"' || sql_text_hash || '","tables_accessed":' || to_json(tables_accessed)::VARCHAR || ',"worker_nodes":4}}'
             WHEN 'openbao' THEN '{{"auth_method":"approle","auth_role":"coordinator","lease_created":' || (k % 2 = 0)::VARCHAR
               || CASE WHEN k % 2 = 0 THEN ',"lease_ttl":3600' ELSE '' END || ',"operation":"' || ['read', 'update', 'delete'][k % 3 + 1]
               || '","path":"secret/' || username || '","remote_address":"' || source_ip || '","vault_request_id":"' || event_id || '"}}'
             ELSE '{{"access_type":"select","policy_name":"' || tenant_id || '_select","policy_version":"2","request_id":"' || event_id
               || '","resource":{{"catalog":"trino","database":"' || db || '","table":"' || split_part(tables_accessed[1], '.', 3) || '","column":"*"}},"result":"'
               || CASE WHEN ranger_decision = 'DENY' THEN 'DENIED' ELSE 'ALLOWED' END || '","row_filter_expression":"tenant_id = ' || chr(39) || tenant_id
               || chr(39) || '","service_name":"trino"}}' END AS detail
    FROM l WHERE k % 41 <> 0 AND k % 53 <> 0 AND k % 59 <> 0""")
def _g6raw(spark, d):
    e = F.col("event")
    return _raw_lines(spark, d)[0].select(
        "event_id", "ts", "source_system", e["event_type"].alias("event_type"), e["action"]["type"].alias("action_type"), e["outcome"].alias("outcome"),
        *[e["actor"][c].alias(c) for c in ("sub", "username", "tenant_id", "ip_address")],
        e["resource"]["type"].alias("resource_type"), e["resource"]["identifier"].alias("identifier"), e["action"]["detail"].alias("detail"))


@register("g6_rejected_raw", f"""
    WITH {_RAW_SQL}
    SELECT k AS number, CASE WHEN k % 41 = 0 THEN 'ftp' ELSE source END AS source,
           CASE WHEN k % 41 = 0 THEN 'unknown source' WHEN k % 53 = 0 THEN 'no JSON' ELSE 'no time' END AS reason
    FROM l WHERE k % 41 = 0 OR k % 53 = 0 OR k % 59 = 0""")
def _g6rej(spark, d):
    return _raw_lines(spark, d)[1].select("number", "source", "reason")


def chained_df(spark, d):
    return aud.chain_events(normalized_df(spark, d))


#: The documents of the trail, their order within segments, Merkle roots by level, heads by segment and
#: links by event, each folded step by step.
_TRAIL_CTES = f"""
    documents_of AS (
      SELECT a.event_id, a."timestamp" AS ts, {_reg_sql(2)} AS source_system, date_trunc('hour', a."timestamp") AS seg,
             to_json({{'action': {{'detail': to_json({{'query_id': query_id, 'rows_scanned': rows_scanned, 'rows_returned': rows_returned,
                                                    'duration_ms': duration_ms, 'decision': ranger_decision}})::VARCHAR, 'type': {_reg_sql(3)}}},
                      'actor': {{'ip_address': source_ip, 'sub': user_sub, 'tenant_id': tenant_id, 'type': 'USER', 'username': username}},
                      'event_id': a.event_id, 'event_type': {_reg_sql(1)},
                      'outcome': CASE WHEN ranger_decision = 'DENY' THEN 'FAILURE' ELSE 'SUCCESS' END,
                      'previous_hash': '__PREVIOUS_HASH__',
                      'resource': {{'identifier': tables_accessed[1], 'location': "cluster", 'type': 'iceberg.table'}},
                      'risk': {{'flags': coalesce(r.risk_flags, []), 'level': coalesce(r.risk_level, 'LOW')}},
                      'schema_version': '1.0', 'source_host': "cluster", 'source_namespace': 'lakehouse',
                      'source_system': {_reg_sql(2)},
                      'timestamp': strftime(a."timestamp", '%Y-%m-%dT%H:%M:%S.%g') || 'Z'}})::VARCHAR AS template
      FROM audit_queries a LEFT JOIN risk r USING (event_id)),
    leaves AS (
      SELECT *, sha256(template) AS leaf, row_number() OVER (PARTITION BY source_system, seg ORDER BY ts, event_id) AS pos FROM documents_of),
    levels(source_system, seg, n, hashes) AS (
      SELECT source_system, seg, count(*), list(leaf ORDER BY pos) FROM leaves GROUP BY ALL
      UNION ALL
      SELECT source_system, seg, n, [CASE WHEN 2 * i <= len(hashes) THEN sha256('1|' || hashes[2 * i - 1] || '|' || hashes[2 * i])
                                          ELSE hashes[2 * i - 1] END for i in range(1, (len(hashes) + 1) // 2 + 1)]
      FROM levels WHERE len(hashes) > 1),
    segments AS (
      SELECT source_system, seg, n, hashes[1] AS root, row_number() OVER (PARTITION BY source_system ORDER BY seg) AS k
      FROM levels WHERE len(hashes) = 1),
    heads(source_system, k, head) AS (
      SELECT DISTINCT source_system, 0::BIGINT, sha256('GENESIS|' || source_system) FROM segments
      UNION ALL
      SELECT s.source_system, s.k, sha256(concat_ws('|', h.head, s.source_system, strftime(s.seg, '%Y-%m-%dT%H:%M:%S'), s.n, s.root))
      FROM heads h JOIN segments s ON s.source_system = h.source_system AND s.k = h.k + 1),
    links(event_id, source_system, seg, pos, ts, previous_hash, this_hash) AS (
      SELECT l.event_id, l.source_system, l.seg, l.pos, l.ts, h.head, sha256(replace(l.template, '__PREVIOUS_HASH__', h.head))
      FROM leaves l JOIN segments s ON s.source_system = l.source_system AND s.seg = l.seg
      JOIN heads h ON h.source_system = s.source_system AND h.k = s.k - 1 WHERE l.pos = 1
      UNION ALL
      SELECT l.event_id, l.source_system, l.seg, l.pos, l.ts, p.this_hash, sha256(replace(l.template, '__PREVIOUS_HASH__', p.this_hash))
      FROM links p JOIN leaves l ON l.source_system = p.source_system AND l.seg = p.seg AND l.pos = p.pos + 1)"""


def trail_ctes(risk: bool = True) -> str:
    """Without risk flags every event has level LOW, as in the stream."""
    none = "SELECT NULL::VARCHAR AS event_id, NULL::VARCHAR AS risk_level, NULL::VARCHAR[] AS risk_flags WHERE FALSE"
    return f"risk AS ({RISK_SQL if risk else none}),{_TRAIL_CTES}"


TRAIL_CTES = trail_ctes()


@register("g7_chain_events", f"""WITH RECURSIVE {TRAIL_CTES}
    SELECT event_id, source_system, ts, previous_hash, this_hash FROM links""")
def _g7(spark, d):
    return chained_df(spark, d).select("event_id", "source_system", "ts", "previous_hash", "this_hash")


@register("g7_seal_segments", f"""WITH RECURSIVE {TRAIL_CTES}
    SELECT s.source_system, s.seg AS seg_hour, s.n AS n_events, s.root, b.head AS first_link, h.head
    FROM segments s JOIN heads h ON h.source_system = s.source_system AND h.k = s.k
    JOIN heads b ON b.source_system = s.source_system AND b.k = s.k - 1""")
def _g7_seals(spark, d):
    return aud.seal_segments(chained_df(spark, d))


def _tampered(chained):
    hit = F.substring("query_id", 3, 20).cast("bigint") % 500 == 0
    return chained.withColumn("doc", F.when(hit, F.regexp_replace("doc", r'"username":"[^"]*"',
                                                                  '"username":"mallory"')).otherwise(F.col("doc")))


@register("g8_verify_chain", f"""
    WITH a AS (SELECT {uuid_sql("'q' || CAST(event_id AS VARCHAR)")} AS event_id, ts, date_trunc('hour', ts) AS seg,
                      {_reg_sql(2)} AS source_system, event_id % 500 = 0 AS tampered FROM events),
    s AS (SELECT source_system, seg, bool_or(tampered) AS hit FROM a GROUP BY ALL),
    p AS (SELECT source_system, seg, lag(hit) OVER (PARTITION BY source_system ORDER BY seg) AS prev_hit FROM s),
    o AS (SELECT a.*, coalesce(prev_hit, FALSE) AND row_number() OVER (PARTITION BY source_system, seg ORDER BY ts, event_id) = 1 AS unlinked
          FROM a JOIN p USING (source_system, seg))
    SELECT event_id, source_system, NOT tampered AS hash_ok, NOT unlinked AS link_ok FROM o WHERE tampered OR unlinked""")
def _g8(spark, d):
    # verification reads the stored trail: the (tampered) chain is written once
    # to the shared checkpoint folder, then verified from there
    stored = materialize(_tampered(chained_df(spark, d)), "trail")
    v = aud.verify_chain(stored)
    return aud.broken_links(v).select("event_id", "source_system", "hash_ok", "link_ok")


def _attacked(chained):
    """A trail whose links are all in order again after an attack: every source lost its first,
    sixth and last segment, and its third one was altered and linked anew from its own anchor."""
    from lakeweave.operators import trail

    s = chained.select("source_system", "seg_hour").distinct()
    w = Window.partitionBy("source_system")
    s = s.select("*", F.row_number().over(w.orderBy("seg_hour")).alias("k"), F.count(F.lit(1)).over(w).alias("m"))
    s = materialize(s, "segments")  # of known size: documents are shuffled only if the segments are too many to be sent to all tasks
    c = chained.join(s, ["source_system", "seg_hour"]).filter("k NOT IN (1, 6) AND k <> m")
    third = c.filter("k = 3")
    rows = third.withColumn("template", F.regexp_replace(F.regexp_replace(
        "doc", '"previous_hash":"[^"]*"', f'"previous_hash":"{trail.PREV_PLACEHOLDER}"'), '"username":"[^"]*"', '"username":"mallory"'))
    anchors = third.groupBy("source_system").agg(F.min_by("previous_hash", F.struct("ts", "event_id")).alias("head"))
    again = trail.chain_templates(rows.select("source_system", "seg_hour", "ts", "event_id", "query_id", "template"), anchors)
    return c.filter("k <> 3").select(*again.columns).unionByName(again)


@register("g8_verify_trail", f"""WITH RECURSIVE {TRAIL_CTES},
    m AS (SELECT *, max(k) OVER (PARTITION BY source_system) AS m FROM segments),
    gone AS (SELECT source_system, seg AS seg_hour, 'missing segment' AS problem FROM m WHERE k IN (1, 6) OR k = m),
    changed AS (SELECT source_system, seg, 'contents differ' FROM m WHERE k = 3 AND k < m),
    ends AS (SELECT DISTINCT source_system, NULL::TIMESTAMP, 'end differs' FROM m),
    starts AS (SELECT source_system, seg, 'first link' FROM m WHERE (k IN (2, 4) OR k = 7) AND k < m)
    SELECT * FROM gone UNION ALL SELECT * FROM changed UNION ALL SELECT * FROM ends UNION ALL SELECT * FROM starts""")
def _g8_trail(spark, d):
    chained = materialize(chained_df(spark, d), "trail", "zstd")  # mostly hexadecimal hashes: half the size of Snappy's
    seals = aud.seal_segments(chained)
    stored = materialize(_attacked(chained), "trail", "zstd")
    columns = ["source_system", "seg_hour", "problem"]
    first = aud.broken_links(aud.verify_chain(stored)).select("source_system", "seg_hour", F.lit("first link").alias("problem"))
    end = aud.verify_heads(stored, aud.chain_heads(chained)).withColumn("seg_hour", F.lit(None).cast("timestamp_ntz"))
    return aud.verify_seals(stored, seals).unionByName(end.select(*columns)).unionByName(first)


@register("g8_inclusion_proofs", f"""WITH RECURSIVE {TRAIL_CTES},
    wanted AS (SELECT l.event_id, l.source_system, l.seg, l.pos - 1 AS position, s.n AS n_events, s.root FROM leaves l
               JOIN segments s ON s.source_system = l.source_system AND s.seg = l.seg
               JOIN audit_queries q ON q.event_id = l.event_id WHERE CAST(substr(q.query_id, 3) AS BIGINT) % 1000 = 0),
    climb(event_id, i, n, steps) AS (
      SELECT event_id, position, n_events, 0 FROM wanted
      UNION ALL
      SELECT event_id, i // 2, (n + 1) // 2, steps + CASE WHEN i % 2 = 1 OR i + 1 < n THEN 1 ELSE 0 END FROM climb WHERE n > 1)
    SELECT w.event_id, w.source_system, w.seg AS seg_hour, w.position, w.n_events, w.root, c.steps::INTEGER AS steps, TRUE AS holds
    FROM wanted w JOIN climb c ON c.event_id = w.event_id AND c.n = 1""")
def _g8_proofs(spark, d):
    chained = materialize(chained_df(spark, d), "trail")
    p = aud.inclusion_proofs(chained, chained.filter(F.substring("query_id", 3, 20).cast("bigint") % 1000 == 0))
    return p.select("event_id", "source_system", "seg_hour", "position", "n_events", "root", F.size("path").alias("steps"),
                    aud.proof_holds(F.col("leaf"), F.col("path"), F.col("root")).alias("holds"))


@register("g9_audit_by_user", """
    SELECT "timestamp", username, tenant_id, query_id, tables_accessed, rows_scanned, ranger_decision, duration_ms
    FROM audit_queries WHERE user_sub = 'sub-0008' AND "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 90 DAY
    ORDER BY "timestamp" DESC, query_id""")
def _g9u(spark, d):
    return aud.audit_by_user(src.audit_queries(spark, d), "sub-0008", "2024-01-31 00:00:00", 90)


@register("g9_audit_by_table", """
    SELECT "timestamp", username, tenant_id, tables_accessed, ranger_decision, sql_text_hash, query_id
    FROM audit_queries WHERE list_contains(tables_accessed, 'tenant_a.marts.customers')
      AND "timestamp" >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY
    ORDER BY "timestamp" DESC, query_id""")
def _g9t(spark, d):
    return aud.audit_by_table(src.audit_queries(spark, d), "tenant_a.marts.customers", "2024-01-31 00:00:00", 30)


@register("g9_erasure_certificates", ERASURE_SQL + """
    SELECT TIMESTAMP '2024-02-01 00:00:00' AS "timestamp", 'gdpr-erasure-job' AS username, subject_id,
           list_sort(list(table_name) FILTER (WHERE rows_removed > 0)) AS tables_affected,
           sha256(subject_id || '|' || '2024-02-01 00:00:00') AS erasure_certificate_id
    FROM r GROUP BY subject_id""")
def _g9e(spark, d):
    cert = gov.erasure_certificate(_erasure(spark, d), "2024-02-01 00:00:00")
    return aud.erasure_certificates(aud.erasure_events(cert))


@register("g10_access_in_window", """
    SELECT query_id, username, "timestamp", ranger_decision FROM audit_queries
    WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-12 00:00:00'
      AND username = 'user8'""")
def _g10(spark, d):
    return aud.access_in_window(src.audit_queries(spark, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00",
                                "user8").select("query_id", "username", "timestamp", "ranger_decision")


@register("g11_denial_spikes", """
    SELECT username, date_trunc('hour', "timestamp") AS window_start,
           date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end, count(*) AS denials
    FROM audit_queries WHERE ranger_decision = 'DENY' GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def _g11(spark, d):
    r = aud.denial_spikes(src.audit_queries(spark, d), "1 hour", 2)
    return r.select("username", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "denials")


@register("g12_append_only_violations", """
    WITH b AS (SELECT query_id, "timestamp", username, duration_ms FROM audit_queries
               WHERE "timestamp" < TIMESTAMP '2024-01-20 00:00:00'),
    a AS (SELECT query_id, "timestamp", username,
                 CASE WHEN CAST(substr(query_id, 3) AS BIGINT) % 1000 = 0 THEN duration_ms + 1 ELSE duration_ms END AS duration_ms
          FROM audit_queries WHERE CAST(substr(query_id, 3) AS BIGINT) % 1500 <> 1)
    SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a."timestamp" = b."timestamp"
                                      AND a.username = b.username AND a.duration_ms = b.duration_ms)""")
def _g12(spark, d):
    full = src.audit_queries(spark, d).select("query_id", "timestamp", "username", "duration_ms")
    n = F.substring("query_id", 3, 20).cast("bigint")
    before = full.filter(F.col("timestamp") < fn.ts_lit("2024-01-20 00:00:00"))
    after = full.filter(n % 1500 != 1).withColumn(
        "duration_ms", F.when(n % 1000 == 0, F.col("duration_ms") + 1).otherwise(F.col("duration_ms")))
    return aud.append_only_violations(before, after)


@register("j7_correlate_audit", """
    WITH a AS (SELECT query_id, "timestamp" AS ts_a FROM audit_queries),
    b AS (SELECT 'q_' || CAST(event_id AS VARCHAR) AS query_id, ts - to_seconds(event_id % 90) AS ts_b, event_type AS b_type
          FROM events WHERE event_type IN ('error', 'click', 'view'))
    SELECT query_id, ts_a, ts_b, b_type, abs(date_diff('microsecond', ts_b, ts_a) / 1e6) AS gap_seconds
    FROM a JOIN b USING (query_id) WHERE abs(date_diff('microsecond', ts_b, ts_a) / 1e6) <= 60""")
def _j7(spark, d):
    a = src.audit_queries(spark, d).select("query_id", F.col("timestamp").alias("ts_a"))
    e = src.read_table(spark, d, "events").filter(F.col("event_type").isin("error", "click", "view"))
    b = e.select(F.concat(F.lit("q_"), F.col("event_id").cast("string")).alias("query_id"),
                 (F.col("ts") - F.make_interval(secs=(F.col("event_id") % 90).cast("decimal(18,6)"))).alias("ts_b"),
                 F.col("event_type").alias("b_type"))
    return aud.correlate_audit(a, b, "query_id", 60)


@register("a15_usage_by_tenant", """
    SELECT tenant_id, username, count(*) AS queries, sum(rows_scanned) AS rows_scanned, sum(rows_returned) AS rows_returned,
           sum(duration_ms) AS duration_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_duration_ms
    FROM audit_queries GROUP BY tenant_id, username""")
def _a15(spark, d):
    return rounded(aud.usage_by_tenant(src.audit_queries(spark, d), exact_percentile=True), ["p95_duration_ms"], 4)


@register("g22_select_audited", f"""
    SELECT * FROM (SELECT *, {_access_decision_sql()} AS decision FROM ({ACCESS_REQUESTS_SQL}))
    WHERE schema IN ('curated', 'raw') AND "table" IN ('customers', 'orders')
      AND access IN ('select', 'insert', 'update', 'delete') AND decision IN ('ALLOW', 'DENY')""")
def _g22(spark, d):
    return aud.select_audited(gov.evaluate_access(access_requests(spark, d), gov.rules_frame(spark)))


@register("w3_growth_anomaly", """
    WITH daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1)
    SELECT day, rows, avg(rows) OVER w AS rolling_avg, coalesce(rows > 1.1 * avg(rows) OVER w, FALSE) AS anomaly
    FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def _w3(spark, d):
    return aud.growth_anomaly(src.read_table(spark, d, "events"), "ts", 7, 1.1)


# ---------------------------------------------------------------------------
# Step 8: telemetry and log analytics
# ---------------------------------------------------------------------------

from lakeweave.operators import telemetry as tm  # noqa: E402
from lakeweave.plans.oracle import bucket as b_sql, bucket_start as bs_sql  # noqa: E402

_TEXT_RE = tm.TEXT_LINE_RE.replace("'", "''")
_IS_JSON = "regexp_full_match(service, 'trino.*|keycloak|elasticsearch|openmetadata.*|airflow.*')"
CLEAN_LINES_SQL = "SELECT * FROM log_lines WHERE NOT regexp_matches(body, '^\\s*$') AND NOT (service LIKE 'trino%' AND contains(body, '/metrics/prometheus'))"
PARSED_SQL = f"""
    SELECT line_id, service, body,
           CASE WHEN {_IS_JSON} THEN try_strptime(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%g')
                ELSE try_strptime(nullif(regexp_extract(body, '{_TEXT_RE}', 1), ''), '%Y-%m-%d %H:%M:%S,%g') END AS log_ts,
           CASE WHEN {_IS_JSON} THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.level') ELSE nullif(regexp_extract(body, '{_TEXT_RE}', 2), '') END AS level,
           CASE WHEN {_IS_JSON} THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.thread') ELSE nullif(regexp_extract(body, '{_TEXT_RE}', 3), '') END AS thread,
           CASE WHEN {_IS_JSON} THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.logger') ELSE nullif(regexp_extract(body, '{_TEXT_RE}', 4), '') END AS logger,
           CASE WHEN {_IS_JSON} THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.message') ELSE nullif(regexp_extract(body, '{_TEXT_RE}', 5), '') END AS message,
           CASE WHEN {_IS_JSON} THEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.event_type') END AS event_type,
           CASE WHEN {_IS_JSON} THEN 'json' ELSE 'text' END AS format
    FROM ({CLEAN_LINES_SQL})"""


def parsed_logs(spark, d):
    return tm.parse_logs(tm.drop_noise(src.log_lines(spark, d)))


@register("m1_parse_logs", PARSED_SQL)
def _m1(spark, d):
    return parsed_logs(spark, d)


@register("m1_object_store_logs", """
    WITH e AS (SELECT event_id AS line_id, CASE WHEN event_id % 3 = 0 THEN 'trino-worker' WHEN event_id % 3 = 1 THEN 'minio-' || CAST(user_id % 4 AS VARCHAR)
                      ELSE 'postgres' END AS service, event_id % 31 = 0 AS broken, * FROM events)
    SELECT line_id, service, CASE WHEN event_id % 3 = 0 AND NOT broken THEN 'io.lake.' || event_type END AS class,
           CASE WHEN event_id % 3 = 1 AND NOT broken THEN 'INFO' END AS level,
           CASE WHEN event_id % 3 = 1 AND NOT broken THEN 'request ' || CAST(event_id AS VARCHAR) END AS message,
           CASE WHEN event_id % 3 = 1 AND NOT broken THEN CASE WHEN event_type = 'purchase' THEN 'PutObject' ELSE 'GetObject' END END AS api,
           CASE WHEN event_id % 3 = 1 AND NOT broken THEN 'bucket-' || CAST(user_id % 7 AS VARCHAR) END AS bucket,
           CASE WHEN event_id % 3 = 1 AND NOT broken AND event_id % 5 <> 0 THEN 'part/' || CAST(event_id AS VARCHAR) END AS object
    FROM e""")
def _m1o(spark, d):
    k, text = F.col("event_id"), lambda c: F.col(c).cast("string")
    service = F.when(k % 3 == 0, "trino-worker").when(k % 3 == 1, F.concat(F.lit("minio-"), (F.col("user_id") % 4).cast("string"))).otherwise("postgres")
    api = F.struct(F.when(F.col("event_type") == "purchase", "PutObject").otherwise("GetObject").alias("name"),
                   F.concat(F.lit("bucket-"), (F.col("user_id") % 7).cast("string")).alias("bucket"),
                   F.when(k % 5 != 0, F.concat(F.lit("part/"), text("event_id"))).alias("object"))
    body = F.to_json(F.struct(F.lit("INFO").alias("level"), F.concat(F.lit("request "), text("event_id")).alias("message"),
                              F.concat(F.lit("io.lake."), F.col("event_type")).alias("class"), api.alias("api")))
    lines = src.read_table(spark, d, "events").select(k.alias("line_id"), service.alias("service"), F.when(k % 31 == 0, F.lit("not { JSON")).otherwise(body).alias("body"))
    return tm.parse_fields(lines).drop("body")


@register("m2_drop_noise", f"""
    SELECT service, count(*) AS lines FROM ({CLEAN_LINES_SQL}) GROUP BY service""")
def _m2(spark, d):
    return tm.drop_noise(src.log_lines(spark, d)).groupBy("service").agg(F.count(F.lit(1)).alias("lines"))


@register("m3_event_type_attribute", f"""
    SELECT event_type, count(*) AS lines FROM ({PARSED_SQL}) WHERE event_type IS NOT NULL GROUP BY event_type""")
def _m3(spark, d):
    return parsed_logs(spark, d).filter(F.col("event_type").isNotNull()).groupBy("event_type") \
                                .agg(F.count(F.lit(1)).alias("lines"))


@register("m4_log_search", f"""
    SELECT line_id, level || ' | ' || logger || ' | ' || message AS line FROM ({PARSED_SQL})
    WHERE service = 'ranger-admin' AND contains(body, 'ERROR')""")
def _m4(spark, d):
    return tm.log_search(parsed_logs(spark, d), "ranger-admin", "ERROR", "%s | %s | %s",
                         ["level", "logger", "message"])


def samples_df(spark, d):
    return src.metric_samples(spark, d)


@register("m5_rate_5m", f"""
    SELECT job, {bs_sql(b_sql('ts', 300), 300)} AS window_start, count(*) AS events, count(*) / 300.0 AS per_second
    FROM metric_samples GROUP BY job, {b_sql('ts', 300)}""")
def _m5(spark, d):
    return tm.rate(samples_df(spark, d), ["job"], 5)


@register("m5_counter_rate", f"""
    WITH s AS (SELECT instance, {b_sql('ts', 300)} AS bucket, count(*) AS requests FROM metric_samples GROUP BY ALL),
    c AS (SELECT instance, {bs_sql('bucket + 1', 300)} AS scrape_ts,
                 sum(requests) OVER (PARTITION BY instance, bucket // 288 ORDER BY bucket) AS counter FROM s),
    r AS (SELECT *, CASE WHEN counter >= lag(counter) OVER w THEN counter - lag(counter) OVER w ELSE counter END AS increase,
                 date_diff('microsecond', lag(scrape_ts) OVER w, scrape_ts) / 1e6 AS dt
          FROM c WINDOW w AS (PARTITION BY instance ORDER BY scrape_ts))
    SELECT instance, scrape_ts, counter, increase, increase / dt AS per_second
    FROM r WHERE lag_ok""".replace("WHERE lag_ok", "WHERE dt IS NOT NULL"))
def _m5c(spark, d):
    b = tm.bucketize(samples_df(spark, d), ["instance"], 300)
    from pyspark.sql import Window as W
    day = F.floor(F.col("bucket") / 288)
    c = b.select("instance", tm.bucket_start(F.col("bucket") + 1, 300).alias("scrape_ts"),
                 F.sum("requests").over(W.partitionBy("instance", day).orderBy("bucket")).alias("counter"))
    return tm.counter_rate(c, ["instance"], "scrape_ts", "counter")


@register("m6_success_ratios", f"""
    WITH b AS (SELECT job, {b_sql('ts', 300)} AS bucket, count(*) AS requests, count(CASE WHEN failed THEN 1 END) AS failures
               FROM metric_samples GROUP BY ALL)
    SELECT job, bucket,
           (sum(requests) OVER w1 - sum(failures) OVER w1) / sum(requests) OVER w1 AS ratio_5m,
           (sum(requests) OVER w12 - sum(failures) OVER w12) / sum(requests) OVER w12 AS ratio_1h,
           (sum(requests) OVER w72 - sum(failures) OVER w72) / sum(requests) OVER w72 AS ratio_6h,
           {bs_sql('bucket + 1', 300)} AS bucket_end
    FROM b WINDOW w1 AS (PARTITION BY job ORDER BY bucket RANGE BETWEEN 0 PRECEDING AND CURRENT ROW),
                  w12 AS (PARTITION BY job ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW),
                  w72 AS (PARTITION BY job ORDER BY bucket RANGE BETWEEN 71 PRECEDING AND CURRENT ROW)""")
def _m6(spark, d):
    return tm.success_ratios(samples_df(spark, d), ["job"])


BURN_SQL = f"""
    WITH b AS (SELECT instance, {b_sql('ts', 300)} AS bucket, count(*) AS requests, count(CASE WHEN failed THEN 1 END) AS failures
               FROM metric_samples GROUP BY ALL),
    r AS (SELECT instance, bucket, (sum(failures) OVER w1 / sum(requests) OVER w1) / 0.005 AS burn_1h,
                 (sum(failures) OVER w6 / sum(requests) OVER w6) / 0.005 AS burn_6h
          FROM b WINDOW w1 AS (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW),
                        w6 AS (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 71 PRECEDING AND CURRENT ROW))
    SELECT instance, bucket, burn_1h, burn_6h,
           CASE WHEN burn_1h > 14.4 AND burn_6h > 14.4 THEN 'critical' WHEN burn_1h > 6.0 AND burn_6h > 6.0 THEN 'warning' END AS severity,
           {bs_sql('bucket + 1', 300)} AS bucket_end
    FROM r"""


@register("m7_burn_rate_alerts", BURN_SQL)
def _m7(spark, d):
    # fixture failure ratios are ~20 %: against a 99.5 % SLO every window burns
    return tm.burn_rate_alerts(samples_df(spark, d), ["instance"], slo=0.995)


@register("m7_burn_rate_firing", f"""
    WITH m AS (SELECT instance, {b_sql('ts', 300)} AS bucket, count(*) AS requests, count(CASE WHEN failed THEN 1 END) AS failures
               FROM metric_samples GROUP BY ALL),
    r AS (SELECT instance, bucket,
                 sum(failures) OVER (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)
                 / sum(requests) OVER (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) / (1::DOUBLE - 0.9::DOUBLE) AS b1,
                 sum(failures) OVER (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 71 PRECEDING AND CURRENT ROW)
                 / sum(requests) OVER (PARTITION BY instance ORDER BY bucket RANGE BETWEEN 71 PRECEDING AND CURRENT ROW) / (1::DOUBLE - 0.9::DOUBLE) AS b6 FROM m),
    a AS (SELECT r.*, alertname, severity, hold FROM r, (VALUES ('CriticalErrorBudgetBurn', 'critical', 14.4, 2), ('WarningErrorBudgetBurn', 'warning', 6.0, 15))
            AS v(alertname, severity, thr, hold) WHERE b1 > thr AND b6 > thr
          UNION ALL
          SELECT r.*, 'ModerateErrorBudgetBurn', 'info', 10 FROM r WHERE b1 > 2 AND b6 > 2),
    i AS (SELECT *, bucket - row_number() OVER (PARTITION BY instance, alertname ORDER BY bucket) AS isl FROM a)
    SELECT alertname, instance, severity, {bs_sql('min(bucket)', 300)} AS starts_at, {bs_sql('max(bucket) + 1', 300)} AS ends_at,
           {bs_sql('min(bucket)', 300)} + to_minutes(any_value(hold)) AS fires_at
    FROM i GROUP BY alertname, instance, severity, isl HAVING (max(bucket) - min(bucket) + 1) * 5 >= any_value(hold)""")
def _m7f(spark, d):
    # with failure ratios of about 20 % and a target of 90 %, a third rule at a burn rate of 2 starts and ends
    s = samples_df(spark, d)
    r = tm.burn_rate_alerts(s, ["instance"], slo=0.9)
    more = tm.sustained_rules(r, ["instance"], [("ModerateErrorBudgetBurn", (F.col("burn_1h") > 2) & (F.col("burn_6h") > 2), 10, "info")])
    return tm.burn_rate_firing(s, ["instance"], slo=0.9).unionByName(more)


def _hq_sql(q: float, le=tm.DEFAULT_LE) -> str:
    parts, lo_b, lo_c = [], "0.0", "0"
    for i, b in enumerate(le):
        c = f"c{i}"
        parts.append(f"WHEN {c} >= {q} * total THEN {lo_b} + ({float(b)} - {lo_b}) * ({q} * total - {lo_c}) / ({c} - {lo_c})")
        lo_b, lo_c = repr(float(b)), c
    return f"CASE WHEN total = 0 THEN NULL {' '.join(parts)} ELSE {float(le[-1])} END"


@register("m8_latency_quantiles", f"""
    WITH h AS (SELECT job, {', '.join(f'count(CASE WHEN latency_s <= {b} THEN 1 END) AS c{i}' for i, b in enumerate(tm.DEFAULT_LE))},
                      count(*) AS total FROM metric_samples GROUP BY job)
    SELECT job, {_hq_sql(0.5)} AS p50, {_hq_sql(0.99)} AS p99,
           c{len(tm.DEFAULT_LE) - 1} / total AS share_le_60s, total AS requests
    FROM h""")
def _m8(spark, d):
    h = tm.histogram(samples_df(spark, d), ["job"], "latency_s")
    r = h.select("job", tm.histogram_quantile(0.5, F.col("cum")).alias("p50"),
                 tm.histogram_quantile(0.99, F.col("cum")).alias("p99"),
                 tm.share_below(F.col("cum"), tm.DEFAULT_LE, 60.0).alias("share_le_60s"),
                 F.col("le_inf").alias("requests"))
    return r


def _alerts_sql(keys=("job",), bucket_seconds=300) -> str:
    k = ", ".join(keys)
    g = (f"SELECT {k}, {b_sql('ts', bucket_seconds)} AS bucket, CAST(count(*) AS DOUBLE) AS requests, "
         f"count(CASE WHEN failed THEN 1 END) / count(*) AS failure_ratio, max(latency_s) AS max_latency_s "
         f"FROM metric_samples GROUP BY ALL")
    parts = []
    for name, gauge, op, thr, for_min, sev in tm.ALERT_RULES:
        isl = (f"SELECT {k}, bucket - row_number() OVER (PARTITION BY {k} ORDER BY bucket) AS isl, bucket "
               f"FROM g WHERE {gauge} {op} {thr}")
        parts.append(
            f"SELECT '{name}' AS alertname, {k}, '{sev}' AS severity, {bs_sql('min(bucket)', bucket_seconds)} AS starts_at, "
            f"{bs_sql('max(bucket) + 1', bucket_seconds)} AS ends_at, "
            f"{bs_sql('min(bucket)', bucket_seconds)} + INTERVAL {for_min} MINUTE AS fires_at "
            f"FROM ({isl}) GROUP BY {k}, isl HAVING (max(bucket) - min(bucket) + 1) * {bucket_seconds / 60.0} >= {for_min}")
    return f"WITH g AS ({g}) " + " UNION ALL ".join(parts)


ALERTS_SQL = _alerts_sql()


def alerts_df(spark, d):
    return tm.threshold_alerts(samples_df(spark, d), ["job"])


@register("m9_threshold_alerts", ALERTS_SQL)
def _m9(spark, d):
    return alerts_df(spark, d)


@register("w4_sustained_failures", f"""
    WITH g AS (SELECT job, {b_sql('ts', 300)} AS bucket, count(CASE WHEN failed THEN 1 END) / count(*) AS failure_ratio
               FROM metric_samples GROUP BY ALL),
    i AS (SELECT job, bucket, bucket - row_number() OVER (PARTITION BY job ORDER BY bucket) AS isl FROM g WHERE failure_ratio > 0.25)
    SELECT job, {bs_sql('min(bucket)', 300)} AS starts_at, {bs_sql('max(bucket) + 1', 300)} AS ends_at,
           (max(bucket) - min(bucket) + 1) * 5.0 AS minutes, {bs_sql('min(bucket)', 300)} + INTERVAL 15 MINUTE AS fires_at
    FROM i GROUP BY job, isl HAVING (max(bucket) - min(bucket) + 1) * 5.0 >= 15""")
def _w4(spark, d):
    g = tm.gauges(samples_df(spark, d), ["job"])
    return tm.sustained(g, ["job"], F.col("failure_ratio") > 0.25, 300, 15)


@register("j8_inhibit_warnings", f"""
    WITH a AS ({ALERTS_SQL})
    SELECT * FROM a WHERE severity <> 'warning'
    UNION ALL
    SELECT * FROM a w WHERE severity = 'warning' AND NOT EXISTS (
        SELECT 1 FROM a c WHERE c.severity = 'critical' AND c.job = w.job
           AND w.fires_at < c.ends_at AND w.ends_at > c.fires_at)""")
def _j8(spark, d):
    return tm.inhibit(alerts_df(spark, d), ["job"])


@register("m10_group_notifications", f"""
    WITH a AS ({ALERTS_SQL}),
    r AS (SELECT *, CASE WHEN severity = 'critical' THEN 'slack-critical' ELSE 'dev-null' END AS receiver,
                 CASE WHEN severity = 'critical' THEN 60 WHEN severity = 'warning' THEN 720 ELSE 240 END AS repeat_minutes FROM a),
    s AS (SELECT *, CASE WHEN lag(fires_at) OVER w IS NULL
                           OR date_diff('microsecond', lag(fires_at) OVER w, fires_at) / 1e6 / 60 > repeat_minutes THEN 1 ELSE 0 END AS nw
          FROM r WINDOW w AS (PARTITION BY alertname, job, receiver ORDER BY fires_at, starts_at)),
    n AS (SELECT *, sum(nw) OVER (PARTITION BY alertname, job, receiver ORDER BY fires_at, starts_at
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS notification_no FROM s)
    SELECT alertname, job, receiver, notification_no, min(fires_at) AS sent_at, count(*) AS alerts
    FROM n GROUP BY alertname, job, receiver, notification_no""")
def _m10(spark, d):
    return tm.group_notifications(alerts_df(spark, d))


@register("m10_notifications", f"""
    WITH RECURSIVE al AS ({ALERTS_SQL}),
    a AS (SELECT alertname, job, CASE WHEN severity = 'critical' THEN 'slack-critical' ELSE 'dev-null' END AS receiver,
                 CASE severity WHEN 'critical' THEN 10000000 WHEN 'warning' THEN 120000000 ELSE 30000000 END AS wait,
                 CASE severity WHEN 'critical' THEN 3600000000 WHEN 'warning' THEN 43200000000 ELSE 14400000000 END AS rep,
                 epoch_us(fires_at) AS f, epoch_us(ends_at) AS e FROM al WHERE ends_at > fires_at),
    b AS (SELECT *, max(e) OVER (PARTITION BY alertname, job, receiver, wait ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM a),
    c AS (SELECT *, sum(CASE WHEN upto IS NULL OR f >= upto THEN 1 ELSE 0 END) OVER (
            PARTITION BY alertname, job, receiver, wait ORDER BY f, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM b),
    s AS (SELECT alertname, job, receiver, wait, rep, episode, list(f ORDER BY f, e) AS fs, list(e ORDER BY f, e) AS es, max(e) AS over_at, min(f) AS f0
          FROM c GROUP BY ALL),
    steps(alertname, job, receiver, wait, rep, episode, fs, es, over_at, t0, tick, before, last) AS (
      SELECT alertname, job, receiver, wait, rep, episode, fs, es, over_at, f0 + wait, f0 + wait, f0 - 1, NULL::BIGINT FROM s
      UNION ALL
      SELECT alertname, job, receiver, wait, rep, episode, fs, es, over_at, t0,
             t0 + CAST(ceil((least(nxt, now_last + rep) - t0) / 300000000.0) AS BIGINT) * 300000000, tick, now_last
      FROM (SELECT *, list_min([x for x in fs if x > tick]) AS nxt,
                   CASE WHEN len([i for i in range(1, len(fs) + 1) if fs[i] <= tick AND es[i] > tick AND (fs[i] > before OR tick - last >= rep)]) > 0
                        THEN tick ELSE last END AS now_last FROM steps WHERE tick < over_at)
      WHERE nxt IS NOT NULL OR now_last IS NOT NULL),
    n AS (SELECT *, len([i for i in range(1, len(fs) + 1) if fs[i] <= tick AND es[i] > tick]) AS active,
                 len([i for i in range(1, len(fs) + 1) if fs[i] <= tick AND es[i] > tick AND fs[i] > before]) AS new_alerts FROM steps WHERE tick < over_at)
    SELECT alertname, job, receiver, make_timestamp(tick) AS sent_at, CASE WHEN new_alerts > 0 THEN 'new' ELSE 'repeat' END AS kind, active, new_alerts
    FROM n WHERE new_alerts > 0 OR (active > 0 AND tick - last >= rep)""")
def _m10n(spark, d):
    return tm.notifications(alerts_df(spark, d))


@register("m11_budget_remaining", f"""
    WITH d AS (SELECT job, {b_sql('ts', 86400)} AS day_no,
                      (count(*) - count(CASE WHEN failed THEN 1 END)) / count(*) AS ratio FROM metric_samples GROUP BY ALL)
    SELECT job, CAST(make_timestamp(day_no * 86400000000) AS DATE) AS day,
           round(avg(ratio) OVER w, 6) AS avg_ratio_28d, round(1 - (1 - avg(ratio) OVER w) / 0.0050000000000000044, 6) AS budget_remaining
    FROM d WINDOW w AS (PARTITION BY job ORDER BY day_no RANGE BETWEEN 27 PRECEDING AND CURRENT ROW)""")
def _m11(spark, d):
    return rounded(tm.budget_remaining(samples_df(spark, d), ["job"]), ["avg_ratio_28d", "budget_remaining"], 6)


@register("m12_pipeline_freshness", """
    WITH r AS (SELECT 'orders_' || strftime(_ingested_at - INTERVAL 1 DAY, '%Y-%m') AS table_name, max(_ingested_at) AS raw_loaded_at,
                      max(month(_ingested_at - INTERVAL 1 DAY)) AS m FROM raw_orders GROUP BY 1),
    j AS (SELECT *, raw_loaded_at + to_hours(CAST(m % 7 AS BIGINT)) AS staging_loaded_at FROM r)
    SELECT count(*) AS tables, round(avg(CAST(date_diff('microsecond', raw_loaded_at, staging_loaded_at) / 3.6e9 <= 4 AS DOUBLE)), 6) AS share_met,
           avg(CAST(date_diff('microsecond', raw_loaded_at, staging_loaded_at) / 3.6e9 <= 4 AS DOUBLE)) >= 0.95 AS slo_met
    FROM j""")
def _m12(spark, d):
    ro = src.raw_orders(spark, d)
    part = F.date_format(F.col("_ingested_at") - F.expr("INTERVAL 1 DAYS"), "yyyy-MM")
    raw = ro.groupBy(F.concat(F.lit("orders_"), part).alias("table_name")).agg(
        F.max("_ingested_at").alias("raw_loaded_at"),
        F.max(F.month(F.col("_ingested_at") - F.expr("INTERVAL 1 DAYS"))).alias("m"))
    stg = raw.select("table_name", (F.col("raw_loaded_at") + F.make_interval(hours=(F.col("m") % 7).cast("int")))
                     .alias("staging_loaded_at"))
    return rounded(tm.pipeline_freshness(raw.drop("m"), stg), ["share_met"], 6)


@register("m13_silent_sources", """
    WITH e AS (SELECT source_system, event_timestamp AS ts FROM raw_events),
    g AS (SELECT source_system, ts AS silent_from,
                 coalesce(lead(ts) OVER (PARTITION BY source_system ORDER BY ts), TIMESTAMP '2024-01-31 00:00:00') AS silent_to FROM e)
    SELECT source_system, silent_from, silent_to, date_diff('microsecond', silent_from, silent_to) / 1e6 / 60 AS gap_minutes
    FROM g WHERE date_diff('microsecond', silent_from, silent_to) / 1e6 / 60 > 10""")
def _m13(spark, d):
    e = src.raw_events(spark, d)
    # same IEEE operations on both sides: compared unrounded
    return tm.silent_sources(e, "source_system", "event_timestamp", "2024-01-31 00:00:00", 10)


@register("m14_brute_force", f"""
    SELECT user_id, {bs_sql(b_sql('ts', 300), 300)} AS window_start, count(*) AS failures
    FROM events WHERE event_type = 'error' GROUP BY user_id, {b_sql('ts', 300)} HAVING count(*) > 1""")
def _m14(spark, d):
    e = src.read_table(spark, d, "events")
    return tm.brute_force(e, "user_id", "ts", F.col("event_type") == "error", 5, 1)


# ---------------------------------------------------------------------------
# Step 7: documents
# ---------------------------------------------------------------------------

from lakeweave.sources import documents as docs  # noqa: E402

RAW_DOCS_SQL = """
    SELECT 'uploads/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS source_key, 'incoming' AS source_bucket,
           text AS extracted_text, CAST(length(text) - length(replace(text, chr(12), '')) + 1 AS BIGINT) AS page_count,
           'run-' || CAST(doc_id % 4 AS VARCHAR) AS run_id, TIMESTAMP '2024-02-01 00:00:00' AS _ingested_at,
           '{"extractor":"docling"}' AS metadata, doc_id, lang
    FROM documents"""


def raw_docs_df(spark, d):
    return docs.raw_documents(spark, d)


@register("s5_ingest_documents", RAW_DOCS_SQL)
def _s5(spark, d):
    return raw_docs_df(spark, d)


@register("a16_document_metrics", f"""
    SELECT source_key_source AS source, lang, run_id, count(*) AS documents, sum(page_count) AS pages,
           sum(length(extracted_text)) AS characters
    FROM (SELECT *, split_part(source_key, '/', 2) AS source_key_source FROM ({RAW_DOCS_SQL})) GROUP BY ALL""")
def _a16(spark, d):
    r = raw_docs_df(spark, d).withColumn("source", F.split("source_key", "/").getItem(1))
    return mdl.document_metrics(r, ["source", "lang", "run_id"])


def _html_sql(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '{docs.BLOCK_END_RE}', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for ent, ch in docs.ENTITIES:
        t = f"replace({t}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


@register("s6_extract_text", f"SELECT page_id, url, {_html_sql('html')} AS text FROM pages")
def _s6(spark, d):
    return docs.extract_text(src.read_table(spark, d, "pages"))


@register("s7_document_paths", f"""
    SELECT source_key,
           'documents/' || regexp_extract(source_key, '([^/]+?)(\\.[^./]*)?$', 1) || '/' || run_id || '/extracted.json' AS extracted_path,
           'raw/documents/' || regexp_extract(source_key, '([^/]+?)(\\.[^./]*)?$', 1) || '/' || run_id || '/'
             || regexp_extract(source_key, '([^/]+)$', 1) AS raw_object_path
    FROM ({RAW_DOCS_SQL})""")
def _s7(spark, d):
    r = raw_docs_df(spark, d)
    k, run = F.col("source_key"), F.col("run_id")
    return r.select("source_key", docs.extracted_path(k, run).alias("extracted_path"),
                    docs.raw_object_path(k, run).alias("raw_object_path"))


@register("s3_new_files", f"""
    WITH l AS (SELECT source_key AS key, doc_id FROM ({RAW_DOCS_SQL})),
    m AS (SELECT 'processed/' || replace(key, '/', '_') || '.done' AS key FROM l WHERE doc_id % 3 = 0)
    SELECT key, doc_id FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = 'processed/' || replace(l.key, '/', '_') || '.done')""")
def _s3(spark, d):
    listing = raw_docs_df(spark, d).select(F.col("source_key").alias("key"), "doc_id")
    markers = listing.filter(F.col("doc_id") % 3 == 0).select(docs.marker_key(F.col("key")).alias("key"))
    return docs.new_files_by_marker(listing, markers)


@register("s8_prepare_raw_documents", f"""
    SELECT source_key, run_id, length(extracted_text) AS text_chars, page_count
    FROM ({RAW_DOCS_SQL})""")
def _s8(spark, d):
    p = docs.prepare_raw_documents(raw_docs_df(spark, d))  # D6 default: 65535 characters
    return p.select("source_key", "run_id", F.length("extracted_text").alias("text_chars"), "page_count")


@register("s17_chunk_documents", """
    WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)),
                                          lambda x: length(trim(x)) > 0) AS l FROM documents),
    e AS (SELECT doc_id, trim(unnest(l)) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM s),
    c AS (SELECT *, CAST(floor(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS BIGINT) AS chunk_id FROM e)
    SELECT doc_id, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS chunk_text, count(*) AS n_sentences,
           length(string_agg(sentence, ' ' ORDER BY pos)) AS n_chars
    FROM c GROUP BY doc_id, chunk_id""")
def _s17(spark, d):
    return docs.chunk_documents(src.read_table(spark, d, "documents"), 1000)


@register("s17_pack_chunks", """
    WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)),
                                                    lambda x: length(trim(x)) > 0) AS l FROM documents),
    e AS (SELECT doc_id, trim(unnest(l)) AS sentence, generate_subscripts(l, 1) AS i FROM s),
    q AS (SELECT doc_id, i, j, substr(sentence, j * 200 + 1, 200) AS piece FROM (SELECT *, unnest(range(0, (length(sentence) - 1) // 200 + 1)) AS j FROM e)),
    p AS (SELECT doc_id, piece, length(piece) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS pos FROM q),
    c(doc_id, pos, chunk_id, used) AS (
      SELECT doc_id, pos, 0::BIGINT, n FROM p WHERE pos = 1
      UNION ALL
      SELECT p.doc_id, p.pos, CASE WHEN c.used + 1 + p.n <= 200 THEN c.chunk_id ELSE c.chunk_id + 1 END,
             CASE WHEN c.used + 1 + p.n <= 200 THEN c.used + 1 + p.n ELSE p.n END
      FROM c JOIN p ON p.doc_id = c.doc_id AND p.pos = c.pos + 1)
    SELECT p.doc_id, c.chunk_id, string_agg(piece, ' ' ORDER BY p.pos) AS chunk_text, CAST(length(string_agg(piece, ' ' ORDER BY p.pos)) AS INTEGER) AS n_chars
    FROM c JOIN p ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id, c.chunk_id""")
def _s17p(spark, d):
    return docs.pack_chunks(src.read_table(spark, d, "documents"), 200)


@register("s1_scan_projection", """
    SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' AND l_returnflag = 'R'""")
def _s1(spark, d):
    return src.read_table(spark, d, "lineitem") \
              .filter((F.col("l_shipdate") >= fn.ts_lit("2000-01-01 00:00:00")) & (F.col("l_returnflag") == "R")) \
              .select("l_orderkey", "l_quantity", "l_extendedprice")


_S9_ORDER = ["item_id", "product_id", "updated_at", "quantity", "unit_price", "discount_pct", "total_price"]


@register("s9_ctas_sample", f"SELECT * FROM order_items ORDER BY {', '.join(_S9_ORDER)} LIMIT 100")
def _s9(spark, d):
    # every column takes part in the order: rows tied on all of them are identical
    return src.order_items(spark, d).orderBy(*_S9_ORDER).limit(100)


@register("s12_layout_order_items", """
    SELECT *, order_id - (order_id % 1000) AS order_bucket FROM order_items""")
def _s12(spark, d):
    from lakeweave.sources.landing import layout
    return layout(src.order_items(spark, d), {"order_bucket": fn.truncate_bucket("order_id", 1000)},
                  sort=["order_id", "line_number"])


@register("s11_generate_customers", f"SELECT * FROM ({CURATED_CUSTOMERS_SQL})")
def _s11(spark, d):
    return curated_customers(spark, d)


def _list_sql(values, seq):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{seq} % {len(values)} + 1]"


@register("s11_generate_products", f"""
    SELECT p_partkey AS product_id, 'SKU-' || {zpad_sql('p_partkey', 6)} AS sku, {_list_sql(gen.PRODUCT_CATEGORIES, 'p_partkey')} AS category,
           p_partkey % 5 <> 0 AS in_stock, CAST(p_partkey * 13 % 500 AS INTEGER) AS stock_qty, p_partkey % 10 <> 9 AS is_active,
           CAST(DATE '2020-01-01' + CAST(p_partkey % 1460 AS INTEGER) AS DATE) AS created_date
    FROM part""")
def _s11p(spark, d):
    return gen.generate_products(src.read_table(spark, d, "part").select(F.col("p_partkey").alias("seq")))


@register("s11_generate_orders", f"""
    SELECT o_orderkey AS order_id, o_orderkey % (SELECT count(*) FROM customer) + 1 AS customer_id,
           CAST(DATE '2022-01-01' + CAST(o_orderkey % 730 AS INTEGER) AS DATE) AS order_date,
           CAST(DATE '2022-01-01' + CAST(o_orderkey % 730 + o_orderkey % 7 + 1 AS INTEGER) AS DATE) AS ship_date,
           {_list_sql(gen.ORDER_STATUSES, 'o_orderkey')} AS status, {_list_sql(gen.CHANNELS, 'o_orderkey')} AS channel,
           CAST(o_orderkey % 5 + 1 AS INTEGER) AS warehouse_id, CASE WHEN o_orderkey % 20 = 0 THEN 'Special order' END AS notes
    FROM orders""")
def _s11o(spark, d):
    n = src.read_table(spark, d, "customer").count()
    return gen.generate_orders(src.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("seq")), n)


@register("s11_generate_order_items", """
    SELECT item_id, CAST(floor((item_id - 1) / 3) AS BIGINT) + 1 AS order_id, item_id % (SELECT count(*) FROM part) + 1 AS product_id,
           CAST(item_id % 5 + 1 AS INTEGER) AS quantity
    FROM (SELECT l_orderkey * 8 + l_linenumber AS item_id FROM lineitem)""")
def _s11i(spark, d):
    n = src.read_table(spark, d, "part").count()
    keys = src.read_table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("seq"))
    return gen.generate_order_items(keys, n)


# ---------------------------------------------------------------------------
# Writers: each query writes to the shared folder and returns what is read back
# ---------------------------------------------------------------------------

def _folder(spark, name):
    from lakeweave.session import shared_dir

    return f"{shared_dir(spark)}/lakeweave/{name}-{uuid4().hex}"


def _extracted(spark, d):
    docs_ = src.read_table(spark, d, "documents")
    run = F.when(F.col("doc_id") % 2 == 0, "run-0").otherwise(F.concat(F.lit("run-"), (F.col("doc_id") % 5).cast("string")))  # half of all rows in a run
    return docs_.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_key"), F.lit("raw").alias("source_bucket"),
                        F.col("text").alias("extracted_text"), F.lit(1).cast("bigint").alias("page_count"), run.alias("run_id"),
                        fn.ts_lit("2024-01-01 00:00:00").alias("_ingested_at"), F.lit("{}").alias("metadata"))


_RUN_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'run-0' ELSE 'run-' || CAST(doc_id % 5 AS VARCHAR) END"


@register("s2_read_extracted", f"""
    SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS source_key, {_RUN_SQL} AS run_id, md5(text) AS text_md5 FROM documents WHERE {_RUN_SQL} = 'run-3'""")
def _s2(spark, d):
    from lakeweave.sources import landing

    path = _folder(spark, "extracted")
    landing.write_extracted(_extracted(spark, d), path)
    return landing.read_extracted(spark, path, "run-3").select("source_key", "run_id", F.md5("extracted_text").alias("text_md5"))


@register("s4_read_formats", """
    SELECT f AS format, c_custkey, c_name, c_acctbal FROM customer, (SELECT unnest(['json', 'csv', 'parquet', 'orc']) AS f)""")
def _s4(spark, d):
    from lakeweave.sources import landing

    c = src.read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    out = []
    for fmt in ("json", "csv", "parquet", "orc"):
        path = _folder(spark, fmt)
        c.write.format(fmt).save(path)
        out.append(landing.read_landing(spark, path, fmt, c.schema).withColumn("format", F.lit(fmt)))
    return landing.union_all(out)


@register("s8_write_raw_documents", f"""
    SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS source_key, {_RUN_SQL} AS run_id, md5(text) AS text_md5 FROM documents""")
def _s8w(spark, d):
    from lakeweave.sources import documents as dl

    path = _folder(spark, "raw")
    dl.write_raw_documents(_extracted(spark, d), path)
    return spark.read.parquet(path).select("source_key", "run_id", F.md5("extracted_text").alias("text_md5"))


@register("s9_ctas_written", "SELECT * FROM order_items ORDER BY item_id LIMIT 100")
def _s9w(spark, d):
    from lakeweave.sources import landing

    path = _folder(spark, "ctas")
    landing.ctas_sample(src.order_items(spark, d), 100, path, ["item_id"])
    return spark.read.parquet(path)


@register("s10_append_batches", "SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders")
def _s10(spark, d):
    from lakeweave.sources import landing

    o = src.read_table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("y"))
    path = _folder(spark, "append")
    for k in range(3):
        landing.append(o.filter(F.col("o_orderkey") % 3 == k), path, ["y"])
    return spark.read.schema(o.schema).parquet(path)


@register("s12_write_layout", "SELECT *, order_id - (order_id % 1000) AS order_bucket FROM order_items")
def _s12w(spark, d):
    from lakeweave.sources import landing

    items, path = src.order_items(spark, d), _folder(spark, "layout")
    landing.write_layout(items, path, {"order_bucket": fn.truncate_bucket("order_id", 1000)}, sort=["order_id", "line_number"])
    return spark.read.schema(items.withColumn("order_bucket", fn.truncate_bucket("order_id", 1000)).schema).parquet(path)


@register("s14_archive_events", """
    SELECT event_id, event_type AS source, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d,
           CAST(hour(ts) AS INTEGER) AS h, value FROM events""")
def _s14(spark, d):
    from lakeweave.sources import landing

    e, path = src.read_table(spark, d, "events").select("event_id", "ts", "event_type", "value"), _folder(spark, "archive")
    landing.archive_events(e, path, "event_type", "ts")
    back = spark.read.schema("event_id bigint, value double, source string, y int, m int, d int, h int").json(path)
    return back.select("event_id", "source", "y", "m", "d", "h", "value")


@register("s15_export_subject", """
    SELECT 'orders' AS table_name, o_orderkey AS id FROM orders WHERE o_custkey = 7
    UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey = 7""")
def _s15(spark, d):
    from lakeweave.sources import landing

    tables = {"orders": src.read_table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id")),
              "customer": src.read_table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("id"))}
    written = landing.export_subject(tables, {"orders": "o_custkey", "customer": "c_custkey"}, 7, _folder(spark, "export"))
    return landing.union_all([spark.read.schema(tables[n].schema).parquet(p).select(F.lit(n).alias("table_name"), "id") for n, p in written.items()])


@register("t8_promote", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'F' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0""")
def _t8p(spark, d):
    o = src.read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    path = _folder(spark, "main")
    tbl.promote(o, path)
    branch = tbl.read_promoted(spark, path).filter(F.col("o_orderkey") % 7 != 0) \
                .withColumn("status", F.when(F.col("o_orderkey") % 10 == 0, "F").otherwise(F.col("status")))
    tbl.promote(branch, path)
    return tbl.read_promoted(spark, path)


# ---------------------------------------------------------------------------
# Step 9: Structured Streaming (each query runs availableNow to a sink in the
# shared checkpoint folder and is read back; compared with batch SQL)
# ---------------------------------------------------------------------------

from lakeweave.streaming import streams as st  # noqa: E402


@register("x1_incremental_ingest", "SELECT event_id, ts, event_type, value FROM events")
def _x1(spark, d):
    s = st.read_fixture_stream(spark, d, "events").select("event_id", "ts", "event_type", "value")
    return st.to_parquet(spark, s, "x1")


@register("x2_stream_rate_5m", f"""
    WITH b AS (SELECT event_type, {b_sql('ts', 300)} AS bucket, count(*) AS events FROM events GROUP BY ALL)
    SELECT event_type, {bs_sql('bucket', 300)} AS window_start, {bs_sql('bucket + 1', 300)} AS window_end, events
    FROM b WHERE {bs_sql('bucket + 1', 300)} <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _x2(spark, d):
    s = st.event_time(st.read_fixture_stream(spark, d, "events"))
    return st.to_parquet(spark, st.windowed_rate(s, "event_type"), "x2")


@register("x3_stream_sliding_ratio", f"""
    WITH e AS (SELECT job, failed, {b_sql('ts', 300)} - k AS start_bucket
               FROM metric_samples, range(0, 12) AS r(k)),
    g AS (SELECT job, start_bucket, count(*) AS requests, count(CASE WHEN failed THEN 1 END) AS failures FROM e GROUP BY ALL)
    SELECT job, {bs_sql('start_bucket', 300)} AS window_start, {bs_sql('start_bucket', 300)} + INTERVAL 1 HOUR AS window_end,
           requests, failures, (requests - failures) / requests AS success_ratio
    FROM g WHERE {bs_sql('start_bucket', 300)} + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _x3(spark, d):
    ev = st.read_fixture_stream(spark, d, "events")
    s = st.event_time(ev.select("ts", F.col("event_type").alias("job"), (F.col("event_type") == "error").alias("failed")))
    return st.to_parquet(spark, st.sliding_success_ratio(s, "job", "failed"), "x3")


@register("x4_late_rejection", """
    SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR""")
def _x4(spark, d):
    _, late = st.split_late(src.read_table(spark, d, "events"), "ts", "2024-01-31 00:00:00", 168)
    return late.select("event_id", "ts", "event_type")


@register("x5_stream_dedup", "SELECT event_id, ts, event_type FROM events")
def _x5(spark, d):
    s = st.event_time(st.read_fixture_stream(spark, d, "events").select("event_id", "ts", "event_type"))
    once = st.dedupe_stream(s.unionByName(s), ["event_id"])  # every event delivered twice
    out = st.to_parquet(spark, once, "x5")
    return out.withColumn("ts", st.ntz(F.col("ts")))


@register("x6_stream_upsert", "SELECT * REPLACE (round(total_amount_usd, 2) AS total_amount_usd) FROM fct_orders")
def _x6(spark, d):
    orders = st.read_fixture_stream(spark, d, "orders")
    rows = mdl.fct_orders(mdl.stg_orders(src.raw_orders(spark, d, orders)), dim_df(spark, d))
    base = st.stream_dir(spark, "x6")
    st.run_available(rows.writeStream.foreachBatch(st.upsert_batch(f"{base}/mart", ["order_id"])), f"{base}/ck")
    return rounded(spark.read.parquet(st.latest_version(spark, f"{base}/mart")), ["total_amount_usd"])


@register("x4_stream_late_rejection", """
    WITH s AS (SELECT event_id, ts, event_type, event_id % 4 AS delivery FROM events),
    m AS (SELECT delivery + 1 AS delivery, max(max(ts)) OVER (ORDER BY delivery) AS mark FROM s GROUP BY delivery)
    SELECT event_id, ts, event_type, coalesce(ts < mark - INTERVAL 168 HOUR, FALSE) AS late
    FROM s LEFT JOIN m USING (delivery)""")
def _x4s(spark, d):
    e = src.read_table(spark, d, "events").select("event_id", "ts", "event_type")
    out = st.stream_dir(spark, "x4")
    st.run_deliveries(spark, [e.filter(F.col("event_id") % 4 == k) for k in range(4)],
                      lambda s: s.writeStream.foreachBatch(st.late_batch(out, "ts", "168 hours")), "x4-in")
    return spark.read.parquet(f"{out}/rows").select("event_id", "ts", "event_type", F.col("late").cast("boolean").alias("late"))


@register("x6_stream_upsert_buckets", "SELECT * REPLACE (round(total_amount_usd, 2) AS total_amount_usd) FROM fct_orders")
def _x6b(spark, d):
    """Three deliveries; the second brings some orders of the first again."""
    o = src.read_table(spark, d, "orders")
    dim = materialize(dim_df(spark, d), "dim")
    rows = lambda s: mdl.fct_orders(mdl.stg_orders(src.raw_orders(spark, d, s)), dim)
    key, out = F.col("o_orderkey"), st.stream_dir(spark, "x6b")
    deliveries = [o.filter(key % 3 != 2), o.filter((key % 3 == 2) & (key % 2 == 0) | (key % 9 == 0)), o.filter((key % 3 == 2) & (key % 2 == 1))]
    st.run_deliveries(spark, deliveries, lambda s: rows(s).writeStream.foreachBatch(st.upsert_buckets(out, ["order_id"], n_buckets=16)), "x6b-in")
    return rounded(st.read_buckets(spark, out, rows(o).schema), ["total_amount_usd"])


@register("x7_stream_chain", f"""WITH RECURSIVE {trail_ctes(risk=False)}
    SELECT l.event_id, l.source_system, l.seg AS seg_hour, l.ts, l.previous_hash, l.this_hash FROM links l
    WHERE l.seg + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def _x7(spark, d):
    ev = src.read_table(spark, d, "events")
    first, last = ev.agg(F.min(fn.epoch_micros("ts")), F.max(fn.epoch_micros("ts"))).first()
    step = ((last - first) // 3 // 3_600_000_000) * 3_600_000_000 + 1_020_000_000  # 17 minutes after a whole hour of the first event
    nth = F.least(((fn.epoch_micros("ts") + F.col("event_id") % 3 * 1_200_000_000 - first) / step).cast("int"), F.lit(2))
    out = st.stream_dir(spark, "x7")
    st.run_deliveries(spark, [ev.filter(nth == k) for k in range(3)], lambda s: st.whole_segments(
        aud.normalize_events(src.audit_queries(spark, d, s), aud.registry_frame(spark))).writeStream.foreachBatch(st.chain_batch(out)), "x7-in")
    return spark.read.parquet(f"{out}/chain").select("event_id", "source_system", "seg_hour", "ts", "previous_hash", "this_hash")


def _orders_asset(spark, d, orders):
    return mdl.stg_orders(src.raw_orders(spark, d, orders)) \
        .withColumn("order_amount", F.col("total_amount_usd")).withColumn("_dbt_source_relation", F.lit("stg_orders"))


def _good_and_reasons(spark, base):
    bad, good = spark.read.parquet(f"{base}/quarantine"), spark.read.parquet(f"{base}/good")
    reasons = bad.select(F.explode("fail_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("reason"), "n"))


@register("x8_stream_quarantine", S13_SQL)
def _x8(spark, d):
    orders = st.read_fixture_stream(spark, d, "orders")
    base = st.stream_dir(spark, "x8")
    st.run_available(_orders_asset(spark, d, orders).writeStream.foreachBatch(st.quarantine_batch(base, S.STAGING_LAYER, ["order_id"])),
                     f"{base}/ck")
    return _good_and_reasons(spark, base)


# of two thirds of the orders every fifth is delivered again with the next delivery
@register("x8_stream_unique", f"""
    WITH a AS ({STG_ASSET_SQL}),
    f AS (SELECT a.order_id, list_filter([{', '.join(f"CASE WHEN coalesce({cond}, FALSE) THEN '{lab}' END" for lab, cond in _S13_FAILS)}],
                                         lambda x: x IS NOT NULL) AS reasons FROM a),
    twice AS (SELECT reasons, FALSE AS again FROM f UNION ALL SELECT reasons, TRUE FROM f WHERE CAST(order_id AS BIGINT) % 5 = 0 AND CAST(order_id AS BIGINT) % 3 < 2),
    r AS (SELECT CASE WHEN again THEN list_append(reasons, 'duplicate:order_id') ELSE reasons END AS reasons FROM twice)
    SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
    UNION ALL SELECT 'good', count(*) FROM r WHERE len(reasons) = 0""")
def _x8u(spark, d):
    o = src.read_table(spark, d, "orders")
    key = F.col("o_orderkey")
    deliveries = [o.filter((key % 3 == k) | ((key % 3 == k - 1) & (key % 5 == 0))) for k in range(3)]
    out = st.stream_dir(spark, "x8u")
    st.run_deliveries(spark, deliveries, lambda s: st.mark_repeats(
        _orders_asset(spark, d, s), ["order_id"], "updated_at", timedelta(days=7300)).writeStream
        .foreachBatch(st.quarantine_batch(out, S.STAGING_LAYER, ["order_id"])), "x8u-in")
    return _good_and_reasons(spark, out)


@register("a12_profile_sketches", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value,
              CAST(max({c}) AS VARCHAR) AS max_value, count(*) AS row_count, TRUE AS distinct_ok, least(count(*), 100) AS sample_size, TRUE AS sample_ok
       FROM fct_orders""" for c in ["order_id", "customer_id", "status", "currency", "country"]))
def _a12s(spark, d):
    """The profile from day sketches, written and read back, beside the exact distinct counts and the sample of one pass."""
    from lakeweave.operators import sketches as sk

    columns = ["order_id", "customer_id", "status", "currency", "country"]
    fct = materialize(fct_df(spark, d), "fct")
    days = materialize(sk.daily(fct, [], F.col("order_date"), columns), "sketches")
    samples = materialize(sk.bottom_sample(fct.select("order_date", "order_id", "status"), ["order_date"], ["order_id", "status"]), "samples")
    p = sk.profile(sk.merged(days), columns)
    exact = qa.profile(fct, columns, exact=True).select("column_name", F.col("distinct_count").alias("exact"))
    once = sk.bottom_sample(fct.select("order_date", "order_id", "status"), [], ["order_id", "status"])
    again = sk.bottom_sample(samples, [], ["order_id", "status"])
    sample = again.agg(F.count(F.lit(1)).alias("sample_size"), F.sum(F.col("_hash").cast("decimal(38,0)")).alias("s")).crossJoin(once.agg(F.sum(F.col("_hash").cast("decimal(38,0)")).alias("t")))
    off = F.abs(F.col("distinct_estimate") - F.col("exact"))
    return p.join(exact, "column_name").crossJoin(F.broadcast(sample)).select(
        "column_name", "null_count", "min_value", "max_value", "row_count", (off <= 1 + 0.065 * F.col("exact")).alias("distinct_ok"),
        "sample_size", (F.col("s") == F.col("t")).alias("sample_ok"))


@register("a15_usage_sketches", """
    SELECT tenant_id, count(*) AS queries, sum(rows_scanned) AS rows_scanned, sum(rows_returned) AS rows_returned,
           sum(duration_ms) AS duration_ms, TRUE AS users_ok, TRUE AS p95_ok
    FROM audit_queries GROUP BY tenant_id""")
def _a15s(spark, d):
    from lakeweave.operators import sketches as sk

    a = src.audit_queries(spark, d)
    days = materialize(sk.daily(a, ["tenant_id"], F.to_date("timestamp"), ["username"], ["rows_scanned", "rows_returned", "duration_ms"]), "sketches")
    m = sk.merged(days, ["tenant_id"]).withColumn("p95", sk.quantile("duration_ms", 0.95)).withColumn("users", sk.distinct_count("username"))
    exact = a.groupBy("tenant_id").agg(F.countDistinct("username").alias("exact"))
    error = sk.rank_error(a, m, ["tenant_id"], "duration_ms", {"p95": 0.95}).withColumnRenamed("p95", "error")
    return m.join(exact, "tenant_id").join(error, "tenant_id").select(
        "tenant_id", F.col("rows").alias("queries"), *[F.col(f"sum_{c}").cast("bigint").alias(c) for c in ("rows_scanned", "rows_returned", "duration_ms")],
        (F.abs(F.col("users") - F.col("exact")) <= 1 + 0.065 * F.col("exact")).alias("users_ok"), (F.col("error") <= 0.0165).alias("p95_ok"))


@register("m8_latency_sketches", """
    SELECT job, count(*) AS requests, min(latency_s) AS min_latency, max(latency_s) AS max_latency, TRUE AS p50_ok, TRUE AS p95_ok, TRUE AS p99_ok
    FROM metric_samples GROUP BY job""")
def _m8s(spark, d):
    from lakeweave.operators import sketches as sk

    s = samples_df(spark, d)
    days = materialize(sk.daily(s, ["job"], F.to_date("ts"), [], ["latency_s"]), "sketches")
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    m = sk.merged(days, ["job"]).select("*", *[sk.quantile("latency_s", v).alias(k) for k, v in q.items()])
    e = sk.rank_error(s, m, ["job"], "latency_s", q).select(F.col("job"), *[(F.col(k) <= 0.0165).alias(f"{k}_ok") for k in q])
    return m.select("job", F.col("rows").alias("requests"), F.col("low_latency_s").alias("min_latency"), F.col("high_latency_s").alias("max_latency")).join(e, "job")


@register("m8_latency_percentiles_raw", """
    SELECT job, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95,
           round(quantile_cont(latency_s, 0.99), 6) AS p99
    FROM metric_samples GROUP BY job""")
def _m8r(spark, d):
    # exact on purpose: latencies carry two decimals, so each group holds a
    # bounded number of distinct values
    r = tm.latency_percentiles(samples_df(spark, d), ["job"], "latency_s", exact=True)
    return rounded(r, ["p50", "p95", "p99"], 6)
