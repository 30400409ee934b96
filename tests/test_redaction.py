"""Redaction of subjects' values against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import governance as gov
from lakeweave.operators import redaction as red


def brute(text, values):
    """Every character of a whole-word occurrence goes; what overlaps is one token."""
    if text is None:
        return None
    hit = []
    low = red.folded(text)
    for v in values:
        v = red.folded(v)
        for m in re.finditer(f"(?={re.escape(v)})", low):
            a, b = m.start(), m.start() + len(v)
            before, after = low[a - 1] if a else " ", low[b] if b < len(low) else " "
            if not (red._word(before) and red._word(v[0])) and not (red._word(after) and red._word(v[-1])):
                hit.append((a, b))
    return red.replaced(text, red.covered(hit), "[REDACTED]")


def test_names_phones_and_ids_go_whatever_their_case(spark):
    rows = [(1, "SELECT * FROM c WHERE name='jane ROE' and phone='+1 555-0100' -- CUST-7"), (2, "Janet Roebuck, CUST-70, 555-0100"),
            (3, None), (4, ""), (5, "Jane Roe Smith x Roe Smith"), (6, "İJane Roe ΣΑΣ ann Annual +1 555-0100")]
    values = ["Jane Roe", "Roe Smith", "+1 555-0100", "CUST-7", "Ann", " Jane Roe ", None, "ab", ""]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.text, r.n) for r in red.redact_values(df, "text", spark.createDataFrame([(v,) for v in values], "value string"), count="n").collect()}
    kept = [v.strip() for v in values if v and len(v.strip()) >= 3]
    assert {i: t for i, (t, _) in got.items()} == {i: brute(t, kept) for i, t in rows}
    assert got[1] == ("SELECT * FROM c WHERE name='[REDACTED]' and phone='[REDACTED]' -- [REDACTED]", 3)
    assert got[2][0] == rows[1][1] and got[5] == ("[REDACTED] x [REDACTED]", 2) and got[3] == (None, 0)
    none = spark.createDataFrame([], "value string")
    assert sorted(map(str, red.redact_values(df, "text", none).collect())) == sorted(map(str, df.collect()))
    assert red.redact_values(df.limit(0), "text", none).count() == 0


@pytest.mark.parametrize("dictionary", [8_000_000, 40_000])
def test_ten_thousand_subjects(spark, monkeypatch, dictionary):
    monkeypatch.setattr(red, "DICTIONARY", dictionary)  # 40,000: several parts
    rng = random.Random(5)
    first, last = ["Ann", "Bo", "Cy", "Dora Lee", "Émile"], ["Roe", "O'Neil", "van Dam", "Šik"]
    people = [(f"CUST-{i:06d}", f"{rng.choice(first)} {rng.choice(last)} {i % 700}", f"+1 555-{i:05d}") for i in range(12_000)]
    subjects = people[:10_000]
    texts = []
    for i in range(400):
        ps = rng.choices(people, k=4)
        texts.append((i, " ".join(rng.choice([p[0], p[1].upper(), p[2], "x" + p[0], p[1] + "9", "plain words"]) + rng.choice(["", ",", "'", "--"]) for p in ps)))
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(people, "cid string, name string, phone string")
    ids = spark.createDataFrame([(s[0],) for s in subjects], "subject_id string")
    values = red.subject_values(ids, "subject_id", {"customers": (table, "cid", ["name", "phone"])})
    got = {r.id: r.text for r in red.redact_values(df, "text", values).collect()}
    every = {x for s in subjects for x in s}
    assert got == {i: brute(t, [v for v in every if red.folded(v) in red.folded(t)]) for i, t in texts}


def test_erasure_counts_what_was_written(spark):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "cid string, v int")
    ids = spark.createDataFrame([("a",), ("z",)], "subject_id string")
    after, results = gov.erase_and_verify({"t": t}, {"t": "cid"}, ids)
    assert after["t"].inputFiles() and sorted(map(str, after["t"].collect())) == ["Row(cid='b', v=3)", "Row(cid=None, v=4)"]
    assert sorted(map(tuple, results.collect())) == [("a", "t", 2, 0), ("z", "t", 0, 0)]
