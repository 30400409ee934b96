"""Checkpoint actions, as carried out."""

from lakeweave.operators import quality as qa
from lakeweave.operators.suites import rule
from lakeweave.operators.tables import read_promoted

NEED = [rule("expect_column_values_to_not_be_null", column="v")]
POLICY = {"raw": "fail_pipeline", "staging": "quarantine", "curated": "block"}


def test_each_action_does_what_it_says(spark, tmp_path):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    bad = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "k int, v string")
    path = str(tmp_path / "one")
    out = qa.carry_out([("r", good, "raw", NEED), ("s", bad, "staging", NEED), ("c", bad, "curated", NEED), ("c2", good, "curated", NEED)],
                       POLICY, path, {"s": ["k"]})
    assert [tuple(r) for r in out.collect()] == [("r", "pass", 2, 2, 0), ("s", "quarantine", 4, 1, 3), ("c", "block", 4, 0, 0), ("c2", "pass", 2, 2, 0)]
    assert [tuple(r) for r in read_promoted(spark, f"{path}/main/s").collect()] == [(3, "c")]
    reasons = {r.v: r.fail_reasons for r in spark.read.parquet(f"{path}/quarantine/s").collect()}
    assert reasons["a"] == ["duplicate:k"] and len(reasons[None]) == 1 and len(reasons) == 3
    assert not (tmp_path / "one/main/c").exists()


def test_a_failed_raw_asset_ends_the_run(spark, tmp_path):
    bad = spark.createDataFrame([(None,)], "v string")
    out = qa.carry_out([("r", bad, "raw", NEED), ("s", bad, "staging", NEED)], POLICY, str(tmp_path / "two"))
    assert [tuple(r) for r in out.collect()] == [("r", "fail_pipeline", 1, 0, 0), ("s", "not_run", None, None, None)]
    assert not (tmp_path / "two").exists()
