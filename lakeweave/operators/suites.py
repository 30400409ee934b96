"""Expectation suites and model tests as rule data.

Fixed values: the rules, thresholds, regular expressions and value sets below
are those of the governed lake's raw, staging and curated suites and of its
model tests; they are data for :func:`lakeweave.operators.quality.validate`.
"""

from __future__ import annotations


def rule(expectation: str, **kwargs) -> dict:
    return {"expectation_type": expectation, "kwargs": kwargs}


UUID_REGEX = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL_REGEX = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
CUSTOMER_ID_REGEX = "^CUST-[0-9]{6,12}$"

RAW_LAYER = [
    rule("expect_column_to_exist", column="event_id"),
    rule("expect_column_to_exist", column="event_timestamp"),
    rule("expect_column_to_exist", column="source_system"),
    rule("expect_column_to_exist", column="ingestion_timestamp"),
    rule("expect_column_values_to_not_be_null", column="event_id", mostly=1.0),
    rule("expect_column_values_to_not_be_null", column="event_timestamp", mostly=0.99),
    rule("expect_column_values_to_be_unique", column="event_id"),
    rule("expect_column_values_to_match_regex", column="event_id", regex=UUID_REGEX, mostly=0.99),
    rule("expect_column_values_to_be_between", column="event_timestamp", min_value="2020-01-01T00:00:00Z",
         max_value="2100-12-31T23:59:59Z", mostly=0.99, parse_strings_as_datetimes=True),
    rule("expect_column_values_to_be_in_set", column="source_system",
         value_set=["crm", "erp", "pos", "web", "mobile", "iot", "partner_api", "manual"], mostly=0.98),
    rule("expect_table_row_count_to_be_between", min_value=1, max_value=50000000),
    rule("expect_table_columns_to_match_set",
         column_set=["event_id", "event_timestamp", "source_system", "ingestion_timestamp", "payload"],
         exact_match=False),
    rule("expect_column_proportion_of_unique_values_to_be_between", column="event_id", min_value=0.99),
]

STAGING_LAYER = [
    rule("expect_column_to_exist", column="customer_id"),
    rule("expect_column_to_exist", column="order_id"),
    rule("expect_column_to_exist", column="order_date"),
    rule("expect_column_to_exist", column="order_amount"),
    rule("expect_column_to_exist", column="status"),
    rule("expect_column_to_exist", column="_dbt_source_relation"),
    rule("expect_column_values_to_not_be_null", column="customer_id", mostly=1.0),
    rule("expect_column_values_to_not_be_null", column="order_id", mostly=1.0),
    rule("expect_column_values_to_not_be_null", column="order_date", mostly=1.0),
    rule("expect_column_values_to_be_unique", column="order_id"),
    rule("expect_column_values_to_be_between", column="order_amount", min_value=0.0, max_value=10000000.0,
         mostly=0.999),
    rule("expect_column_values_to_be_in_set", column="status",
         value_set=["pending", "confirmed", "fulfilled", "cancelled", "refunded", "disputed"], mostly=1.0),
    rule("expect_column_values_to_be_between", column="order_date", min_value="2015-01-01",
         max_value="2100-12-31", mostly=0.999, parse_strings_as_datetimes=True),
    rule("expect_table_row_count_to_be_between", min_value=1, max_value=100000000),
    rule("expect_column_values_to_match_regex", column="customer_id", regex=CUSTOMER_ID_REGEX, mostly=0.99),
    rule("expect_column_pair_values_to_be_equal", column_A="_source_event_id", column_B="event_id",
         ignore_row_if="either_value_is_missing", mostly=1.0),
]

CURATED_LAYER = [
    rule("expect_column_to_exist", column="customer_id"),
    rule("expect_column_to_exist", column="total_revenue"),
    rule("expect_column_to_exist", column="order_count"),
    rule("expect_column_to_exist", column="first_order_date"),
    rule("expect_column_to_exist", column="last_order_date"),
    rule("expect_column_to_exist", column="region"),
    rule("expect_column_to_exist", column="email"),
    rule("expect_column_values_to_not_be_null", column="customer_id", mostly=1.0),
    rule("expect_column_values_to_not_be_null", column="total_revenue", mostly=1.0),
    rule("expect_column_values_to_not_be_null", column="order_count", mostly=1.0),
    rule("expect_column_values_to_be_unique", column="customer_id"),
    rule("expect_column_values_to_be_between", column="total_revenue", min_value=0.01, max_value=999999999.99,
         mostly=0.999),
    rule("expect_column_values_to_be_between", column="order_count", min_value=1, max_value=100000, mostly=1.0),
    rule("expect_column_values_to_be_between", column="first_order_date", min_value="2015-01-01",
         max_value="2100-12-31", parse_strings_as_datetimes=True, mostly=1.0),
    rule("expect_column_pair_values_A_to_be_greater_than_B", column_A="last_order_date",
         column_B="first_order_date", or_equal=True, ignore_row_if="either_value_is_missing", mostly=1.0),
    rule("expect_column_values_to_be_in_set", column="region",
         value_set=["EMEA", "APAC", "AMER", "LATAM", "MENA", "unknown"], mostly=0.999),
    rule("expect_column_values_to_match_regex", column="email", regex=EMAIL_REGEX, mostly=0.95),
    rule("expect_table_row_count_to_be_between", min_value=100, max_value=50000000),
    rule("expect_column_values_to_be_between", column="total_revenue", min_value=0.01, max_value=10000000.0,
         mostly=0.999),
]

SUITES = {"raw_layer": RAW_LAYER, "staging_layer": STAGING_LAYER, "curated_layer": CURATED_LAYER}

# What a failing suite does to its assets (checkpoint policy per layer).
ON_FAILURE = {"raw_layer": "fail_pipeline", "staging_layer": "quarantine",
              "curated_layer": "block_promotion_and_page"}

# Model tests (not_null / unique / accepted_values without tolerance), with
# the status vocabulary as a parameter of the check (decision D2).
ORDER_STATUSES = ["pending", "processing", "shipped", "completed", "cancelled", "returned", "refunded"]

MODEL_TESTS = {
    "stg_customers": [
        rule("expect_column_values_to_not_be_null", column="customer_id"),
        rule("expect_column_values_to_be_unique", column="customer_id"),
        rule("expect_column_values_to_not_be_null", column="email"),
    ],
    "stg_orders": [
        rule("expect_column_values_to_not_be_null", column="order_id"),
        rule("expect_column_values_to_be_unique", column="order_id"),
        rule("expect_column_values_to_not_be_null", column="customer_id"),
        rule("expect_column_values_to_be_in_set", column="status", value_set=ORDER_STATUSES),
    ],
    "rpt_revenue_by_region": [
        rule("expect_column_values_to_not_be_null", column="country"),
        rule("expect_column_values_to_be_unique", column="country"),
    ],
}

# The tests of all sources and models. Column -> tests; a list of values stands for accepted_values.
_STATUSES = ["pending", "processing", "completed", "cancelled", "refunded"]
_KEY, _SET = ["not_null", "unique"], ["not_null"]
_CUSTOMER = {"customer_id": _KEY, "email": _SET, "first_name": _SET, "last_name": _SET, "country": _SET, "created_at": _SET}
TABLE_TESTS: dict[str, dict[str, list]] = {
    "raw_customers": _CUSTOMER | {"_ingested_at": _SET},
    "raw_orders": {"order_id": _KEY, "customer_id": _SET, "order_date": _SET, "status": ["not_null", _STATUSES], "total_amount": _SET,
                   "currency": [["USD", "EUR", "GBP", "JPY", "CAD", "AUD"]], "_ingested_at": _SET},
    "raw_products": {"product_id": _KEY, "name": _SET, "category": _SET, "price": _SET, "_ingested_at": _SET},
    "raw_documents": {"run_id": _SET, "source_key": _SET, "extracted_text": _SET, "_ingested_at": _SET},
    "stg_customers": _CUSTOMER | {"full_name": _SET, "_ingested_at": _SET},
    "stg_orders": {"order_id": _KEY, "customer_id": _SET, "order_date": _SET, "status": ["not_null", _STATUSES], "total_amount_usd": _SET,
                   "is_completed": _SET, "_ingested_at": _SET},
    "stg_products": {"product_id": _KEY, "name": _SET, "category": _SET, "price": _SET, "_ingested_at": _SET},
    "dim_customers": {"customer_key": _KEY} | _CUSTOMER | {"full_name": _SET, "_dbt_updated_at": _SET},
    "fct_orders": {"order_id": _KEY, "customer_key": _SET, "customer_id": _SET, "order_date": _SET, "status": ["not_null", _STATUSES],
                   "total_amount_usd": _SET, "is_completed": _SET},
    "rpt_revenue_by_region": {"country": _KEY, "total_orders": _SET, "completed_orders": _SET, "total_revenue_usd": _SET, "completion_rate": _SET},
}
