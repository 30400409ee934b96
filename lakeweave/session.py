"""Spark session helpers.

The library never creates its own cluster settings when a session already
exists: a production job gets its session from the platform, and only tests
and the benchmark build a local one through :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a local run needs; on a cluster these come from the job submit.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lakeweave", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("LAKEWEAVE_DRIVER_MEMORY", "16g")))
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by driver and executors.

    On a cluster the platform sets it to a fault-tolerant path and we only read
    it. Only a local-mode session without one gets a fresh scratch folder; any
    other master without the setting is an error, because a machine-local folder
    would be lost with its machine and unseen by the others.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="lakeweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """:func:`shared_dir`, also set as the folder of ``DataFrame.checkpoint``."""
    current = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df: DataFrame, label: str = "stage", codec: str | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is
    cut, later readers prune columns, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/lakeweave/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete the folders that :func:`materialize` wrote for frames that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lakeweave/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_parallelism(df: DataFrame, factor: int = 1) -> DataFrame:
    """Spread CPU-heavy per-row work over the cluster when the input arrives
    in fewer partitions than there are cores (e.g. one small file).

    The decision reads only the planned partition count (file splits are
    metadata), never data. On a large input the scan already yields
    thousands of splits and this is a no-op, so no shuffle is added at scale."""
    if df.isStreaming:
        return df  # micro-batches are planned per trigger
    # Only scan-side plans are inspected: after any shuffle the partition count
    # is spark.sql.shuffle.partitions already, and asking an adaptive plan for
    # its partitions would run its shuffle stages.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(k in plan for k in ("Join", "Aggregate", "Window", "Repartition", "Sort", "Expand", "Limit")):
        return df
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
