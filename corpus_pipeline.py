"""From raw documents to packed training windows, in stages that each write Parquet.

1. ``quality_rules``: base rules and cross-document line frequency (operator 2);
   rejected documents go.
2. ``toxicity``: nearest labelled examples (operator 4), fitted on the labelled rows
   among what is left; rejected documents go.
3. ``ngram_jaccard_join``: near copies by five-word shingles at a Jaccard similarity
   of 0.8 (operator 9); the document with the least id of each group stays.
4. ``packing``: mixture-controlled windows of 1024 tokens (operator 7).

A document's verdict depends on its text and host alone in stage 1, and on its
text alone in stage 2, so repeated rows share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.line_rules import quality_rules
from lakeweave.llm.ngram_join import one_of_each
from lakeweave.llm.packing import op7_mixture_packing
from lakeweave.llm.text import table
from lakeweave.llm.toxicity import fit, toxicity_scores
from lakeweave.session import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("source").isNull(), "source")
    slim = docs.select("text", "source", key.alias("_key"))
    rejected = quality_rules(slim, keep=("_key",)).filter(~F.col("kept")).select("_key").distinct()
    return docs.withColumn("_key", key).join(rejected, "_key", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return toxicity_scores(rows, model, ["_row"]).filter(F.col("predicted") == 0).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_mixture_packing(spark, sf_dir, docs)


STAGES = [("quality_rules", drop_low_quality), ("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies),
          ("packing", pack_windows)]

#: Toxicity and tokens cannot be put in SQL; tests hold each stage's operator against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
