"""S11 synthetic row generators, driven by keys of existing tables.

The generators are pure column formulas over an integer ``seq`` column, so
they run wherever the key rows are (no driver-side lists of rows). Feeding
them the fixture keys (c_custkey, p_partkey, ...) keeps every registered
query tied to the given tables. The multipliers, ranges and dates in the formulas
are fixed values of the seed data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.columns import zpad

# Category and tier vocabularies of the seed generator.
LOYALTY_TIERS = ("bronze", "silver", "gold", "platinum")
PRODUCT_CATEGORIES = ("Electronics", "Clothing", "Food", "Home", "Sports", "Books", "Toys", "Health")
ORDER_STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled", "returned")
CHANNELS = ("web", "mobile", "phone", "in-store", "partner")


def _pick(values: tuple[str, ...], seq: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (seq % len(values) + 1).cast("int"))


def _days_after(date: str, n: Column) -> Column:
    return F.date_add(F.lit(date).cast("date"), n.cast("int"))


def generate_customers(keys: DataFrame, seq: str = "seq") -> DataFrame:
    """curated.customers with PII columns (phone, ssn, date of birth)."""
    s = F.col(seq)
    ssn9 = zpad((F.lit(100000000) + s % 900000000).cast("string"), 9)
    return keys.select(
        s.alias("customer_id"),
        F.concat(F.lit("user"), s.cast("string"), F.lit("@example"), (s % 5 + 1).cast("string"),
                 F.lit(".com")).alias("email"),
        F.concat(F.lit("+1-"), (F.lit(200) + s % 800).cast("string"), F.lit("-"),
                 F.lpad((s % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat_ws("-", F.substring(ssn9, 1, 3), F.substring(ssn9, 4, 2), F.substring(ssn9, 6, 4)).alias("ssn"),
        _days_after("1970-01-01", s % 18000).alias("date_of_birth"),
        _days_after("2018-01-01", s % 2190).alias("signup_date"),
        _pick(LOYALTY_TIERS, s).alias("loyalty_tier"),
        (F.lit(500) + (s * 137) % 99500).cast("decimal(12,2)").alias("annual_revenue"),
        *[c for c in keys.columns if c != seq],
    )


def generate_products(keys: DataFrame, seq: str = "seq") -> DataFrame:
    s = F.col(seq)
    return keys.select(
        s.alias("product_id"),
        F.concat(F.lit("SKU-"), zpad(s.cast("string"), 6)).alias("sku"),
        _pick(PRODUCT_CATEGORIES, s).alias("category"),
        ((s % 5) != 0).alias("in_stock"),
        ((s * 13) % 500).cast("int").alias("stock_qty"),
        ((s % 10) != 9).alias("is_active"),
        _days_after("2020-01-01", s % 1460).alias("created_date"),
    )


def generate_orders(keys: DataFrame, n_customers: int, seq: str = "seq") -> DataFrame:
    """curated.orders; ``n_customers``: how many customers there are, all of which get orders."""
    s = F.col(seq)
    return keys.select(
        s.alias("order_id"),
        (s % n_customers + 1).alias("customer_id"),
        _days_after("2022-01-01", s % 730).alias("order_date"),
        _days_after("2022-01-01", s % 730 + s % 7 + 1).alias("ship_date"),
        _pick(ORDER_STATUSES, s).alias("status"),
        _pick(CHANNELS, s).alias("channel"),
        (s % 5 + 1).cast("int").alias("warehouse_id"),
        F.when(s % 20 == 0, F.lit("Special order")).alias("notes"),
    )


def generate_order_items(keys: DataFrame, n_products: int, seq: str = "seq") -> DataFrame:
    """curated.order_items, three to an order; ``n_products``: how many products there are, all of which are ordered."""
    s = F.col(seq)
    return keys.select(
        s.alias("item_id"),
        (F.floor((s - 1) / 3).cast("bigint") + 1).alias("order_id"),
        (s % n_products + 1).alias("product_id"),
        (s % 5 + 1).cast("int").alias("quantity"),
    )
