"""Access decisions by the rule index against a search through all rules."""

import random
import re

import pytest

from lakeweave.operators import governance as gov

RULES = "rule_id int, kind string, grp string, catalog string, schema string, tbl string, accesses array<string>, schema_not_in array<string>"
REQUESTS = "id int, groups array<string>, catalog string, schema string, table string, access string"


def fits(pattern, value):
    return value is not None and re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), value, re.S) is not None


def decided(request, rules):
    _, groups, cat, sch, tbl, access = request
    hit = [r for r in rules if r[2] in (groups or []) and access in r[6] and fits(r[3], cat) and fits(r[4], sch) and fits(r[5], tbl)
           and not (r[1] == "deny" and r[7] and f"{cat}/{sch}" in r[7])]
    return "DENY" if not hit or any(r[1] == "deny" for r in hit) else "ALLOW"


@pytest.mark.parametrize("n_rules", [40, 10_000])
def test_same_decisions_as_a_search_through_all_rules(spark, n_rules):
    rng = random.Random(n_rules)
    word = lambda: "".join(rng.choices("ab.*(", [5, 5, 1, 0, 1], k=rng.randint(1, 4)))
    glob = lambda: rng.choice(["*", word(), word() + "*", "*" + word(), word() + "*" + word(), word() + "**" + word() + "*" + word()])
    rules = [(i, rng.choice(["allow", "allow", "deny"]), f"g{rng.randrange(1 + n_rules // 8)}", rng.choice(["*", "lake", "l*"]), glob(), glob(),
              rng.sample(["select", "insert", "use"], rng.randint(1, 2)), rng.choice([None, ["lake/a", "lake/ab"]])) for i in range(n_rules)]
    values = ["", "a", "ab", "a.b", "abab", "aba(b", None, "b"] + [word() for _ in range(30)]
    requests = [(i, rng.choice([None, []] + [[f"g{rng.randrange(1 + n_rules // 8)}", "g0"]] * 8), rng.choice(["lake", "lake", "other", None]), rng.choice(values),
                 rng.choice(values), rng.choice(["select", "insert", "drop"])) for i in range(600)]
    got = {r.id: r.decision for r in gov.evaluate_access(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(rules, RULES)).collect()}
    assert got == {q[0]: decided(q, rules) for q in requests}
    assert len(set(got.values())) == 2


def test_plan_builds_no_pattern_and_keeps_all_requests(spark):
    requests = spark.createDataFrame([(1, ["a"], "c", "s", "t", "select")] * 3, REQUESTS)
    out = gov.evaluate_access(requests, spark.createDataFrame([], RULES))
    assert [r.decision for r in out.collect()] == ["DENY"] * 3
    out = gov.evaluate_access(requests, gov.rules_frame(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp_replace" not in plan and out.count() == 3
