"""Benchmark queries A2-A6 (TPC-H Q1, Q3, Q6, Q10, Q19) adapted to the
fixtures as FIXTURES.md §3 describes.

Written with the DataFrame API so that Catalyst pushes the date / discount /
quantity predicates into the Parquet scans, prunes columns, and AQE picks the
join strategy from runtime sizes. Only nation (25 rows at every scale factor)
is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.columns import ts_lit
from lakeweave.sources.tables import read_table


def _disc_price() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 pricing summary: 8 aggregates by return flag and line status."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.filter(F.col("l_shipdate") <= ts_lit("1998-09-02"))
            .groupBy("l_returnflag", "l_linestatus")
            .agg(F.sum("l_quantity").alias("sum_qty"),
                 F.sum("l_extendedprice").alias("sum_base_price"),
                 F.sum(_disc_price()).alias("sum_disc_price"),
                 F.sum(_disc_price() * (1 + F.col("l_tax"))).alias("sum_charge"),
                 F.avg("l_quantity").alias("avg_qty"),
                 F.avg("l_extendedprice").alias("avg_price"),
                 F.avg("l_discount").alias("avg_disc"),
                 F.count(F.lit(1)).alias("count_order"))
            .orderBy("l_returnflag", "l_linestatus"))


def q3(spark: SparkSession, sf_dir: str, segment: str = "BUILDING", date: str = "1995-03-15",
       k: int = 10) -> DataFrame:
    """A3 shipping priority (o_shippriority -> o_orderpriority), top k."""
    c = read_table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == segment).select("c_custkey")
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < ts_lit(date)) \
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > ts_lit(date)) \
        .select("l_orderkey", "l_extendedprice", "l_discount")
    j = (c.join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey))
    return (j.groupBy("l_orderkey", "o_orderdate", "o_orderpriority")
            .agg(F.sum(_disc_price()).alias("revenue"))
            .select("l_orderkey", "revenue", "o_orderdate", "o_orderpriority")
            .orderBy(F.col("revenue").desc(), F.col("o_orderdate"), F.col("l_orderkey"))
            .limit(k))


def q6(spark: SparkSession, sf_dir: str, year_start: str = "1996-01-01", year_end: str = "1997-01-01") -> DataFrame:
    """A4 forecast revenue change: one filtered global sum."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.filter((F.col("l_shipdate") >= ts_lit(year_start)) & (F.col("l_shipdate") < ts_lit(year_end))
                      & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
            .agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue")))


def q10(spark: SparkSession, sf_dir: str, start: str = "1996-10-01", end: str = "1997-01-01",
        k: int = 20) -> DataFrame:
    """A5 returned items: top k customers by lost revenue."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    o = read_table(spark, sf_dir, "orders") \
        .filter((F.col("o_orderdate") >= ts_lit(start)) & (F.col("o_orderdate") < ts_lit(end))) \
        .select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R") \
        .select("l_orderkey", "l_extendedprice", "l_discount")
    n = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = (o.join(li, li.l_orderkey == o.o_orderkey)
          .join(c, c.c_custkey == o.o_custkey)
          .join(n, F.col("c_nationkey") == n.n_nationkey))
    return (j.groupBy("c_custkey", "c_name", "c_acctbal", "n_name")
            .agg(F.sum(_disc_price()).alias("revenue"))
            .select("c_custkey", "c_name", "revenue", "c_acctbal", "n_name")
            .orderBy(F.col("revenue").desc(), F.col("c_custkey"))
            .limit(k))


# The three Q19 branches as adapted in FIXTURES.md §3
# (brand, p_type set, quantity range, size upper bound).
Q19_BRANCHES = (
    ("Brand#12", ("SMALL", "PROMO"), (1, 11), 5),
    ("Brand#23", ("MEDIUM", "STANDARD"), (10, 20), 10),
    ("Brand#4", ("LARGE", "ECONOMY"), (20, 30), 15),
)


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 discounted revenue: equi-join on part key plus an OR of three
    conjunctions. The equi-key is explicit, so no nested-loop join appears;
    Catalyst pulls the common brand/quantity bounds down as pre-filters."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    cond = None
    for brand, types, (qlo, qhi), smax in Q19_BRANCHES:
        c = ((F.col("p_brand") == brand) & F.col("p_type").isin(*types)
             & (F.col("l_quantity") >= qlo) & (F.col("l_quantity") <= qhi)
             & F.col("p_size").between(1, smax))
        cond = c if cond is None else (cond | c)
    # Coarse single-table pre-filters implied by the OR (help pushdown).
    p = p.filter(F.col("p_brand").isin(*[b[0] for b in Q19_BRANCHES]) & F.col("p_size").between(1, 15))
    li = li.filter(F.col("l_quantity").between(1, 30))
    return li.join(p, li.l_partkey == p.p_partkey).filter(cond) \
             .agg(F.sum(_disc_price()).alias("revenue"))


QUERIES = {"q1": q1, "q3": q3, "q6": q6, "q10": q10, "q19": q19}
