"""Operator 5: contiguous shards of nearly equal bytes by global prefix sums.

Rows are put in the order of a key over range partitions; each partition gives
one total, the totals are summed to offsets, and every row then knows how many
bytes lie before it in the whole table. The line of bytes is cut at equal
targets, a row going to the shard that holds its middle byte. So shards are
contiguous in the key, and their sizes differ by no more than one row's size
from the target at either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakeweave.llm.text import table
from lakeweave.session import materialize


def prefix_sums(df: DataFrame, key: str, size: Column) -> tuple[DataFrame, int]:
    """``df`` with ``_size``, ``_before`` (bytes of all rows ahead of this one in
    the order of ``key``), ``_index`` (rows ahead), and the total of all sizes.

    The range partition of each row is written down with it, so the totals and
    the running sums see one and the same partitioning even if a task is run
    again. Only one row per partition (its number, bytes, rows) goes through the
    driver. Rows with an equal key are ordered by a hash of all their columns;
    rows equal in every column may stand in either order."""
    spark = df.sparkSession
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    placed = materialize(
        df.withColumn("_size", size).withColumn("_tie", tie)
        .repartitionByRange(F.col(f"`{key}`"), F.col("_tie"))
        .withColumn("_part", F.spark_partition_id()), "prefix")
    totals = sorted(placed.groupBy("_part").agg(F.sum("_size"), F.count(F.lit(1))).collect())
    rows, bytes_before, rows_before = [], 0, 0
    for part, nbytes, n in totals:
        rows.append((part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + nbytes, rows_before + n
    offsets = spark.createDataFrame(rows, "_part int, _bytes_before long, _rows_before long")
    within = Window.partitionBy("_part").orderBy(F.col(f"`{key}`"), "_tie")
    running = (placed
               .withColumn("_before", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
               .withColumn("_index", (F.row_number().over(within) - 1).cast("long")))
    out = (running.join(F.broadcast(offsets), "_part")  # one row per range partition
           .withColumn("_before", F.col("_before") + F.col("_bytes_before"))
           .withColumn("_index", F.col("_index") + F.col("_rows_before"))
           .drop("_part", "_tie", "_bytes_before", "_rows_before"))
    return out, bytes_before


def balanced_shards(df: DataFrame, n_shards: int, key: str, size: Column) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (place in the
    shard, gapless from 0), contiguous in ``key`` and near equal in ``size``.

    ``size`` must be positive. Null keys come first; repeated rows each take a
    slot of their own; an empty table gives an empty result; input columns of
    the names ``shard``, ``slot`` or those with a leading underscore used here
    are replaced."""
    df = df.drop("shard", "slot", "_size", "_tie", "_part", "_before", "_index")
    placed, total = prefix_sums(df, key, size)
    middle = f"(2 * _before + _size) * {n_shards} div {2 * max(total, 1)}"
    cut = placed.withColumn("shard", F.least(F.expr(middle), F.lit(n_shards - 1)).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return (cut.join(F.broadcast(firsts), "shard")
            .withColumn("slot", F.col("_index") - F.col("_first"))
            .drop("_index", "_first", "_before", "_size"))


def op5_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    return balanced_shards(slim, 24, "doc_id", F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
