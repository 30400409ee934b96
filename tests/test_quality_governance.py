import hashlib

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import governance as gov
from lakeweave.operators import quality as qa
from lakeweave.operators.suites import rule


def _res(df, suite):
    return {r.rule_index: r for r in qa.validate(df, suite, "s").collect()}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        (1, "a@x.io", 10.0, "pending", "2024-01-01", 1.0, 2.0),
        (2, "bad", 20.0, "done", "not a date", 3.0, 3.0),
        (3, None, None, None, None, 5.0, 4.0),
        (3, "c@x.io", 99.0, "pending", "2024-02-01", None, 1.0),
    ], "id long, email string, amount double, status string, day string, a double, b double")


def test_every_rule_passes_and_fails(people):
    suite = [
        rule("expect_column_to_exist", column="id"), rule("expect_column_to_exist", column="nope"),
        rule("expect_column_values_to_not_be_null", column="email", mostly=0.7),
        rule("expect_column_values_to_not_be_null", column="email"),
        rule("expect_column_values_to_be_unique", column="id"),
        rule("expect_column_values_to_match_regex", column="email", regex=r"^\S+@\S+$", mostly=0.6),
        rule("expect_column_values_to_be_between", column="amount", min_value=0, max_value=50),
        rule("expect_column_values_to_be_between", column="day", min_value="2024-01-01", max_value="2024-12-31",
             parse_strings_as_datetimes=True),
        rule("expect_column_values_to_be_in_set", column="status", value_set=["pending"], mostly=0.5),
        rule("expect_table_row_count_to_be_between", min_value=1, max_value=3),
        rule("expect_table_columns_to_match_set", column_set=["id", "email"], exact_match=False),
        rule("expect_column_proportion_of_unique_values_to_be_between", column="id", min_value=0.7),
        rule("expect_column_pair_values_A_to_be_greater_than_B", column_A="b", column_B="a", or_equal=True),
        rule("expect_column_pair_values_to_be_equal", column_A="a", column_B="b", mostly=0.3),
    ]
    r = _res(people, suite)
    assert [r[i].success for i in range(len(suite))] == [
        True, False, True, False, False, True, False, False, True, False, True, True, False, True]
    assert r[3].unexpected_count == 1 and r[3].element_count == 4
    assert r[4].unexpected_count == 2  # both rows with id 3
    assert r[6].unexpected_count == 1 and r[6].element_count == 3  # NULL ignored
    assert r[7].unexpected_count == 1  # unparsable date counts as unexpected
    assert r[11].observed_value == pytest.approx(0.75)
    assert r[12].element_count == 3 and r[12].unexpected_count == 1


def test_empty_table_column_rules_pass(spark):
    empty = spark.createDataFrame([], "id long")
    r = _res(empty, [rule("expect_column_values_to_not_be_null", column="id"),
                     rule("expect_column_values_to_be_unique", column="id"),
                     rule("expect_table_row_count_to_be_between", min_value=1)])
    assert [r[i].success for i in range(3)] == [True, True, False]


def test_split_quarantine_reasons(people):
    suite = [rule("expect_column_values_to_not_be_null", column="email"),
             rule("expect_column_values_to_be_in_set", column="status", value_set=["pending"])]
    good, bad = qa.split_quarantine(people, suite, unique_keys=["id"])
    assert good.count() == 1 and bad.count() == 3
    reasons = {r.id: sorted(r.fail_reasons) for r in bad.collect() if r.email is None}
    assert reasons[3] == sorted(["0:column_values_to_not_be_null:email", "duplicate:id"])


def test_pii_scan_counts(spark):
    df = spark.createDataFrame([("mail a@b.com and c@d.org, card 4111 1111 1111 1111",), ("nothing here",)], "t string")
    rows = qa.pii_scan(df, "t").collect()
    assert rows[0].email_count == 2 and rows[0].card_count == 1 and rows[0].has_pii
    assert not rows[1].has_pii


def test_schema_drift(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([(1, 2)], "id int, age int")
    got = sorted((r.column_name, r.change) for r in qa.schema_drift(a, b).collect())
    assert got == [("age", "added"), ("id", "retyped"), ("name", "dropped")]


def test_consecutive_failures(spark):
    runs = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.99, 0.9, 0.9, 0.9, 0.99])],
                                 "suite string, run_ts long, pass_rate double")
    assert [r.alert for r in qa.consecutive_failures(runs).orderBy("run_ts").collect()] == \
        [False, False, False, True, False]


# ---------------------------------------------------------------------------
# Governance
# ---------------------------------------------------------------------------

CUST = "lakehouse.curated.customers"


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "alice@x.io", "+1-555-0100", "123-45-6789", "AMERICA"),
                                  (2, "bob@y.io", None, "987-65-4321", "EUROPE")],
                                 "customer_id long, email string, phone string, ssn string, region string")


def test_masks_per_group(customers):
    a = gov.mask_columns(customers, CUST, gov.Principal("a", ("data-analysts",))).orderBy("customer_id").collect()
    assert a[0].email == hashlib.sha256(b"alice@x.io").hexdigest() and a[0].phone is None and a[0].ssn is None
    s = gov.mask_columns(customers, CUST, gov.Principal("s", ("data-stewards",))).orderBy("customer_id").collect()
    assert s[0].email == "alicxxxxxx" and s[0].phone == "+1-5xxxxxxx" and s[0].ssn is None
    adm = gov.mask_columns(customers, CUST, gov.Principal("p", ("platform-admins",))).orderBy("customer_id").collect()
    assert adm[0].ssn == "123-45-6789"


def test_mask_never_changes_row_count(customers):
    for g in ("data-analysts", "data-stewards", "data-engineers", "platform-admins", "nobody"):
        assert gov.mask_columns(customers, CUST, gov.Principal("u", (g,))).count() == customers.count()


def test_mask_types(spark):
    df = spark.createDataFrame([("Abc123", "2001-07-04")], "s string, d string").withColumn("d", F.col("d").cast("date"))
    from pyspark.sql.types import DateType, StringType
    r = df.select(gov.mask_expr(F.col("s"), "MASK", StringType()).alias("m"),
                  gov.mask_expr(F.col("s"), "MASK_SHOW_LAST_4", StringType()).alias("l4"),
                  gov.mask_expr(F.col("d"), "MASK_DATE_SHOW_YEAR", DateType()).alias("y")).first()
    assert r.m == "Xxxnnn" and r.l4 == "xxc123" and str(r.y) == "2001-01-01"


def test_row_filter(customers):
    ana = gov.Principal("a", ("data-analysts",), {"ranger.assigned_region": "EUROPE"})
    assert [r.customer_id for r in gov.row_filter(customers, CUST, ana).collect()] == [2]
    assert gov.row_filter(customers, CUST, gov.Principal("e", ("data-engineers",))).count() == 2
    assert gov.row_filter(customers, CUST, gov.Principal("x", ("guests",))).count() == 0


def test_decide_deny_beats_allow_and_default_deny():
    both = gov.Principal("u", ("data-analysts", "data-stewards"))
    assert gov.decide(both, "lakehouse", "raw", "orders", "select") == "DENY"
    assert gov.decide(both, "lakehouse", "curated", "orders", "select") == "ALLOW"
    assert gov.decide(gov.Principal("g", ("guests",)), "lakehouse", "curated", "orders", "select") == "DENY"
    assert gov.decide(gov.Principal("s", ("data-stewards",)), "lakehouse", "raw", "orders", "insert") == "DENY"


def test_distributed_access_matches_plan_time_decision(spark):
    groups = [("data-analysts",), ("data-stewards",), ("data-engineers",), ("platform-admins",),
              ("data-analysts", "data-stewards"), ("guests",)]
    reqs = [(i, list(g), "lakehouse", s, "orders", a) for i, (g, s, a) in enumerate(
        (g, s, a) for g in groups for s in ("raw", "staging", "curated") for a in ("select", "insert", "drop"))]
    df = spark.createDataFrame(reqs, "rid long, groups array<string>, catalog string, schema string, "
                                     "table string, access string")
    got = {r.rid: r.decision for r in gov.evaluate_access(df, gov.rules_frame(spark)).collect()}
    for rid, g, c, s, t, a in reqs:
        assert got[rid] == gov.decide(gov.Principal("u", tuple(g)), c, s, t, a), (g, s, a)


def test_secure_select_denied(customers):
    with pytest.raises(gov.AccessDenied):
        gov.secure_select(customers, "lakehouse.raw.customers", gov.Principal("a", ("data-analysts",)))


def test_erase_twice_equals_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "cid long, v string")
    ids = spark.createDataFrame([(2,)], "subject_id long")
    once = gov.erase_subject({"t": t}, {"t": "cid"}, ids)["t"]
    twice = gov.erase_subject({"t": once}, {"t": "cid"}, ids)["t"]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (3, "c")]
    res = gov.erasure_results({"t": t}, {"t": once}, {"t": "cid"}, ids).first()
    assert (res.rows_removed, res.rows_left) == (1, 0)


def test_redact_only_subjects(spark):
    df = spark.createDataFrame([("u1", "mail me at a@b.com"), ("u2", "c@d.com")], "u string, txt string")
    subj = spark.createDataFrame([("u1",)], "u string")
    out = dict((r.u, r.txt) for r in gov.redact(df, "txt", subjects=subj, subject_key="u").collect())
    assert out == {"u1": "mail me at [REDACTED]", "u2": "c@d.com"}


def test_lineage_upstream(spark):
    from lakeweave.operators.lineage import lineage
    edges = spark.createDataFrame([("fct_orders", "stg_orders"), ("stg_orders", "raw_orders"),
                                   ("rpt", "fct_orders"), ("fct_orders", "dim_customers"),
                                   ("dim_customers", "stg_customers")], "child string, parent string")
    start = spark.createDataFrame([("rpt",)], "node string")
    got = {r.node: r.depth for r in lineage(edges, start, "upstream").collect()}
    assert got == {"fct_orders": 1, "stg_orders": 2, "dim_customers": 2, "raw_orders": 3, "stg_customers": 3}


def test_quarantine_pii(spark):
    df = spark.createDataFrame([(1, "write to a@b.com"), (2, "token = abcdefghijklmnopqrstu"), (3, "plain")],
                               "id long, t string")
    clean, flagged = qa.quarantine_pii(df, "t")
    assert [r.id for r in clean.collect()] == [3]
    assert {r.id: r.pii_found for r in flagged.collect()} == {1: ["email"], 2: ["secret"]}
