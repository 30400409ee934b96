"""Redaction of personal values in free text.

A request names subjects; every value that identifies one of them (name, id, phone, e-mail,
address) goes from all texts, whoever wrote them. All values are matched in one pass over a
text with an Aho-Corasick automaton, so cost does not grow with the number of subjects. The
dictionary is dealt by hash into parts of a bounded size; beyond one part the texts are read once
per part, and only places are carried on, so a task never holds more than one automaton.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.session import materialize

TOKEN = "[REDACTED]"
DICTIONARY = 8_000_000  # characters of values held by a task at once


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Dictionary:
    """Whole-word occurrences of many values, regardless of case."""

    def __init__(self, values):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for v in values:
            self.automaton.add_word(folded(v), len(folded(v)))
        self.automaton.make_automaton() if len(self.automaton) else None

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places [a, b) of values that no letter, digit or underscore continues."""
        if not len(self.automaton):
            return []
        low, out = folded(text), []
        for last, n in self.automaton.iter(low):
            a, b = last - n + 1, last + 1
            if a and _word(low[a - 1]) and _word(low[a]) or b < len(low) and _word(low[b]) and _word(low[b - 1]):
                continue
            out.append((a, b))
        return out


def covered(spans) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def replaced(text: str, spans: list[tuple[int, int]], token: str) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], token]
        at = b
    return "".join(parts) + text[at:]


def subject_values(subjects: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(``value``): the subjects' keys and what the mapped tables hold of them. ``tables``: name ->
    (table, its key column, its identifying columns)."""
    ids = subjects.select(F.col(key).cast("string").alias("_id")).distinct()
    out = ids.select(F.col("_id").alias("value"))
    for df, k, columns in tables.values():
        hit = df.join(ids, F.col(k).cast("string") == F.col("_id"))
        out = out.unionByName(hit.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")))
    return out


def redact_values(df: DataFrame, col: str, values: DataFrame, token: str = TOKEN, min_length: int = 3, count: str | None = None) -> DataFrame:
    """``df`` with every whole-word occurrence of a value in ``col`` replaced by ``token``, regardless of case;
    overlapping occurrences become one token, so no piece of a value is left. ``count`` names a column for the
    number of tokens set.

    ``values`` has a column ``value``; null and repeated ones, and those with fewer than ``min_length`` characters
    after trimming (they would hit ordinary words), are left out. A null text stays null."""
    v = values.select(F.trim(F.col("value").cast("string")).alias("value")).filter(F.length("value") >= min_length).distinct()
    v = materialize(v, "values")
    size = v.agg(F.sum(F.length("value"))).first()[0] or 0
    parts = max(1, -(-size // DICTIONARY))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    names = df.columns
    place, rows = names.index(col), df
    if parts > 1:  # places are gathered part by part
        rows = df.withColumn("_spans", F.array().cast("array<struct<a:int,b:int>>"))
        for k in range(parts):
            held = [r[0] for r in v.filter(F.pmod(F.xxhash64("value"), F.lit(parts)) == k).toLocalIterator()]  # about DICTIONARY characters
            rows = materialize(rows.mapInArrow(_gather(df.sparkSession.sparkContext.broadcast(held), place), rows.schema), "redaction")
        sent = None
    else:
        sent = df.sparkSession.sparkContext.broadcast([r[0] for r in v.toLocalIterator()])
    schema = T.StructType([*df.schema.fields] + ([T.StructField(count, T.LongType())] if count else []))

    def run(batches):
        dictionary = Dictionary(sent.value) if sent else None
        for batch in batches:
            out, n = [], []
            for i, text in enumerate(batch.column(place)):
                text = text.as_py()
                if text is None:
                    spans = []
                elif dictionary:
                    spans = covered(dictionary.spans(text))
                else:
                    spans = covered((s["a"], s["b"]) for s in batch.column(len(names))[i].as_py())
                n.append(len(spans))
                out.append(replaced(text, spans, token) if spans else text)
            columns = [*batch.columns[:len(names)]]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns + [pa.array(n, pa.int64())] * (count is not None), names=schema.names)

    return rows.mapInArrow(run, schema)


def _gather(sent, place: int):
    def run(batches):
        dictionary = Dictionary(sent.value)
        for batch in batches:
            spans = [old.as_py() + [{"a": a, "b": b} for a, b in (dictionary.spans(t.as_py()) if t.is_valid else [])]
                     for t, old in zip(batch.column(place), batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return run
