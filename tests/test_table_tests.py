"""Tests of tables, each with a row that breaks it."""

from lakeweave.operators import quality as qa


def test_every_kind_of_failure_is_counted(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "c", "x"), (2, "zz", "y"), (None, "zz", "q"), (None, None, None)], "id int, s string, t string")
    tests = {"t": {"id": ["not_null", "unique"], "s": [["a", "b", "c"]], "t": ["not_null", "unique", ["x", "y", "q"]]}, "none": {"id": ["not_null", "unique", [1]]}}
    got = {(r.table_name, r.column_name, r.test): (r.failures, r.status, r.table_rows) for r in qa.table_tests({"t": df, "none": df.limit(0)}, tests).collect()}
    assert got == {("t", "id", "not_null"): (2, "fail", 6), ("t", "id", "unique"): (2, "fail", 6), ("t", "s", "accepted_values"): (1, "fail", 6),
                   ("t", "t", "not_null"): (2, "fail", 6), ("t", "t", "unique"): (1, "fail", 6), ("t", "t", "accepted_values"): (0, "pass", 6),
                   ("none", "id", "not_null"): (0, "pass", 0), ("none", "id", "unique"): (0, "pass", 0), ("none", "id", "accepted_values"): (0, "pass", 0)}
