"""Landing-zone readers and sinks.

Readers always take an explicit schema (no inference pass over 100 TB);
writers partition by the table's declared transforms so later scans prune.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

EXTRACTED_SCHEMA = StructType([
    StructField("source_key", StringType()),
    StructField("source_bucket", StringType()),
    StructField("extracted_text", StringType()),
    StructField("page_count", LongType()),
    StructField("run_id", StringType()),
    StructField("_ingested_at", TimestampNTZType()),
    StructField("metadata", StringType()),
])

# Formats of the landing zone that the runtime can read. Avro needs the
# external spark-avro package, which is not on the classpath.
LANDING_FORMATS = ("json", "csv", "parquet", "orc", "xml", "text")


def read_landing(spark: SparkSession, path: str | Sequence[str], fmt: str,
                 schema: StructType | str | None = None, **options) -> DataFrame:
    """Read one landing format with a declared schema."""
    if fmt not in LANDING_FORMATS:
        raise ValueError(f"unsupported landing format {fmt!r}; supported: {LANDING_FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("json", "csv", "xml"):
        raise ValueError("text formats need an explicit schema (no inference at scale)")
    return reader.load(path)


def write_extracted(df: DataFrame, path: str) -> None:
    """S2 counterpart: JSON records in a folder per run (``run_id=<run>``)."""
    spread(df, ["run_id"]).write.mode("append").partitionBy("run_id").json(path)


def read_extracted(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """JSON extraction records of one run. Reads the whole run (no cap on
    the number of files, decision D4). Where runs have folders ``run_id=<run>`` the
    run is a partition, so only its folder is listed and read; in a flat folder
    the filter is on the record."""
    df = spark.read.schema(EXTRACTED_SCHEMA).json(path)
    return df.filter(F.col("run_id") == run_id).select(*EXTRACTED_SCHEMA.names)


def spread(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows clustered by ``keys`` for a write: tasks of about the advisory size, small ones merged, a key with
    very many rows split over several (so it gets several files). Adaptive execution decides by
    measured sizes; nothing depends on how rows are dealt."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def new_files(listing: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Listed objects without a processed marker (anti join)."""
    return listing.join(processed.select(key).distinct(), key, "left_anti")


def ctas_sample(df: DataFrame, n: int, path: str, order: Sequence[str] | None = None) -> None:
    """CREATE TABLE AS SELECT ... LIMIT n. With ``order`` the sample is
    deterministic (top-n by the given columns)."""
    out = df.orderBy(*order).limit(n) if order else df.limit(n)
    out.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append a batch to a table directory."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def layout(df: DataFrame, partition: Mapping[str, Column] | Sequence[str] = (),
           sort: Sequence[str] = ()) -> DataFrame:
    """Add derived partition columns (month(col), truncate(col, w), ...)
    and cluster rows by them, sorted within each task by ``sort``: files are
    then few per partition value and carry tight min/max statistics; a value
    with very many rows is written by several tasks."""
    if isinstance(partition, Mapping):
        for name, expr in partition.items():
            df = df.withColumn(name, expr)
        pcols = list(partition.keys())
    else:
        pcols = list(partition)
    if pcols:
        df = spread(df, pcols)
    if sort or pcols:
        df = df.sortWithinPartitions(*pcols, *sort)
    return df


def write_layout(df: DataFrame, path: str, partition: Mapping[str, Column] | Sequence[str] = (),
                 sort: Sequence[str] = (), mode: str = "overwrite") -> None:
    """S12 writer."""
    pcols = list(partition.keys()) if isinstance(partition, Mapping) else list(partition)
    w = layout(df, partition, sort).write.mode(mode)
    if pcols:
        w = w.partitionBy(*pcols)
    w.parquet(path)


def archive_events(df: DataFrame, path: str, source_col: str = "source_system", ts_col: str = "timestamp") -> None:
    """Cold NDJSON archive, gzip, one file group per source and hour."""
    ts = F.col(ts_col)
    out = (df.withColumn("source", F.col(source_col))
             .withColumn("y", F.year(ts)).withColumn("m", F.month(ts))
             .withColumn("d", F.dayofmonth(ts)).withColumn("h", F.hour(ts)))
    keys = ["source", "y", "m", "d", "h"]
    (spread(out, keys).sortWithinPartitions(*keys, ts_col)
        .write.mode("append").partitionBy(*keys).option("compression", "gzip").json(path))


def export_subject(tables: Mapping[str, DataFrame], key_cols: Mapping[str, str], subject_id: str,
                   path: str, fmt: str = "parquet") -> dict[str, str]:
    """Portability export of one subject, one folder per table. The scan runs in all its
    tasks; what it finds is merged by size."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(fmt)
    written = {}
    for name, df in tables.items():
        out = df.filter(F.col(key_cols[name]) == F.lit(subject_id))
        target = f"{path.rstrip('/')}/{name}"
        w = spread(out).write.mode("overwrite")
        (w.option("header", True).csv(target) if fmt == "csv" else w.format(fmt).save(target))
        written[name] = target
    return written


def union_all(dfs: Iterable[DataFrame]) -> DataFrame:
    dfs = list(dfs)
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
