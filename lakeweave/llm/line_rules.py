"""Operator 2: quality rules and cross-document line frequency.

Every line of a text is normalised (lower case, runs of white space as one
space, ends trimmed) and hashed. Per host the distinct documents that hold a line
are counted; exact copies of a text are one document. A line above the limits is
boilerplate and is removed, and a document of which too little is left is
rejected.

Groups of near copies would raise the count of all their lines, although such a
text is no boilerplate. Boilerplate, of one line or many, stands beside text of the
document's own; a copied text consists of lines that others have as well. So a line
must be over the limits among the documents that are mostly their own: of whose words
at most ``common_share`` lie in lines over the limits. Documents that consist mostly of
such lines count for nothing, but lose the lines that the others show to be boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm.text import table
from lakeweave.session import materialize

SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineRules:
    """Limits. A line is frequent in a host if more than ``min_docs`` distinct
    documents and more than ``doc_share`` of the host's documents hold it. The share
    lets lines of large hosts occur by chance or by subject; at 0.2 %, the menu of a
    section with one in 500 pages of a host still counts. A document is depleted
    if under ``left_share`` of its words are left."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_docs: int = 20
    doc_share: float = 0.002
    common_share: float = 0.5
    left_share: float = 0.3


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 1 << 21:
        key = (seq[:-2] * v + seq[1:-1]) * v + seq[2:]
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, group, count = np.unique(np.stack([seq[:-2], seq[1:-1], seq[2:]], 1), axis=0,
                                    return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[group.ravel()] > 1)
    marked = np.zeros(n, bool)
    for j in range(3):
        marked[at + j] = True
    return int(marked.sum())


def normalise(line: bytes) -> bytes:
    return b" ".join(line.split()).decode("utf-8", "replace").lower().encode()


def text_row(raw: bytes) -> tuple:
    """(words, characters in words, symbols, duplicate lines, repeated words,
    hash of the text, [hash of each line with a word], [words of each])."""
    words = raw.split()
    text = raw.decode("utf-8", "replace")
    chars = len(text) - sum(text.count(c) for c in GAPS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = raw.split(b"\n")
    with_word = [(x, n) for x in lines if (n := len(x.split()))]
    dup = len(with_word) - len({x for x, _ in with_word})
    signed = [xxhash.xxh3_64_intdigest(normalise(x)) - (1 << 63) for x, _ in with_word]
    return (len(words), chars, symbols, dup, repeated_words(words), xxhash.xxh3_64_intdigest(raw) - (1 << 63),
            signed, [n for _, n in with_word])


STATS = T.StructType([T.StructField(c, T.LongType()) for c in
                      ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_text")]
                     + [T.StructField("_lines", T.ArrayType(T.LongType())), T.StructField("_sizes", T.ArrayType(T.IntegerType()))])


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One pass over the texts: ``keep`` columns and ``STATS``."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *STATS.fields])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = [text_row(x) for x in part.column(len(keep)).to_pylist()]
                cols = [pa.array(c, type=t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=schema.names)

    return docs.select(*keep, F.coalesce(docs[text], F.lit("")).cast("binary")).mapInArrow(run, schema)


def frequent_lines(stats: DataFrame, rules: LineRules) -> DataFrame:
    """(``_host``, ``_line``) of the lines to be removed. ``stats`` has one row per
    document with ``_host``, ``_text``, ``_lines``, ``_sizes``, ``n_words``.

    All counts are partial aggregations before their shuffle, so neither a host
    with a third of the rows nor a line in every document meets in one task."""
    texts = stats.groupBy("_host", "_text").agg(F.sum("n_words").alias("_words"))  # copies of a text are one document
    hosts = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_host_docs"))
    lines = (stats.select("_host", "_text", F.explode(F.arrays_zip("_lines", "_sizes")).alias("x"))
             .groupBy("_host", F.col("x._lines").alias("_line"), "_text").agg(F.sum("x._sizes").alias("_size")))

    def over_limits(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") > rules.min_docs)
        return counts.join(hosts, "_host").filter(F.col("_docs") > rules.doc_share * F.col("_host_docs")).select("_host", "_line")

    common = materialize(lines.join(over_limits(lines), ["_host", "_line"], "left_semi"), "common")
    copied = (common.groupBy("_host", "_text").agg(F.sum("_size").alias("_common")).join(texts, ["_host", "_text"])
              .filter(F.col("_common") > rules.common_share * F.col("_words")).select("_host", "_text"))
    return over_limits(common.join(copied, ["_host", "_text"], "left_anti"))


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), host: str = "source", text: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with the counts of the text, ``base_failed``,
    ``kept``, ``n_removed_lines``, ``n_removed_words``.

    Null and empty texts have no words and fail the base rules. A null host is a
    host of its own. Repeated rows each keep their row and get the same verdict.
    An empty table gives an empty result; other columns do not matter, and kept
    columns must not have the names of the results."""
    clean = docs.withColumn("_host", F.xxhash64(F.col(f"`{host}`").isNull(), F.col(f"`{host}`")))
    stats = materialize(text_stats(clean, [*keep, "_host"], text).withColumn("_row", F.monotonically_increasing_id()), "lines")
    removed = (stats.select("_row", "_host", F.explode(F.arrays_zip("_lines", "_sizes")).alias("x"))
               .select("_row", "_host", F.col("x._lines").alias("_line"), F.col("x._sizes").alias("_size"))
               .join(frequent_lines(stats, rules), ["_host", "_line"], "left_semi")
               .groupBy("_row").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("_size").alias("n_removed_words")))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < rules.left_share * F.col("n_words")
    return (stats.join(removed, "_row", "left")
            .withColumn("n_removed_lines", F.coalesce("n_removed_lines", F.lit(0)))
            .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
            .select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
                    "n_removed_lines", "n_removed_words"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


#: The same over the whole table, on the lines themselves instead of hashes.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
l0 AS (SELECT rid, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS raw FROM d),
l1 AS (SELECT rid, source, text, k, raw, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l0),
l2 AS (SELECT rid, source, text, k, raw, len(ws) AS size, lower(array_to_string(ws, ' ')) AS line FROM l1 WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM l2 GROUP BY rid),
held AS (SELECT source, text, line, sum(size) AS size FROM l2 GROUP BY ALL),
t AS (SELECT d.source, d.text, sum(len(ws)) AS words FROM d JOIN w USING (rid) GROUP BY ALL),
h AS (SELECT source, count(*) AS host_docs FROM t GROUP BY source),
lim AS (SELECT held.source, line FROM held JOIN h ON held.source IS NOT DISTINCT FROM h.source
        GROUP BY held.source, line, host_docs HAVING count(*) > 20 AND count(*) > 0.002 * host_docs),
common AS (SELECT held.* FROM held JOIN lim ON held.source IS NOT DISTINCT FROM lim.source AND held.line = lim.line),
own AS (SELECT t.source, t.text FROM t LEFT JOIN (SELECT source, text, sum(size) AS size FROM common GROUP BY ALL) c
        ON t.source IS NOT DISTINCT FROM c.source AND t.text = c.text WHERE coalesce(c.size, 0) <= 0.5 * t.words),
freq AS (SELECT c.source, c.line FROM common c JOIN own ON c.source IS NOT DISTINCT FROM own.source AND c.text = own.text
         JOIN h ON c.source IS NOT DISTINCT FROM h.source
         GROUP BY c.source, c.line, host_docs HAVING count(*) > 20 AND count(*) > 0.002 * host_docs),
gone AS (SELECT rid, count(*) AS lines, sum(size) AS words FROM l2
         JOIN freq ON l2.source IS NOT DISTINCT FROM freq.source AND l2.line = freq.line GROUP BY rid),
j AS (SELECT doc_id, len(ws) AS n_words,
        length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.lines, 0) AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept,
  n_removed_lines, n_removed_words FROM j
"""
