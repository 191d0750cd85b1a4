"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

# Only settings that change results (time zone) or protect against skew.  Parallelism is left
# to the cluster: AQE coalesces or splits shuffle partitions from the sizes it measures.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the operator above would have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keyed stream state grows with the keys: keep it on disk instead of in executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    """Session for tests and the local bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewlake")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("REVIEWLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a local one in local mode.

    The local one is removed when the driver ends; what lies in a configured folder belongs to whoever set it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="reviewlake-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor replays from files and not from the whole loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Constant rows as a local relation: Spark knows its size and joins it without a shuffle.

    (A DataFrame made from a list of tuples is an RDD of unknown size to the optimizer.)
    """
    names = [c.strip().split()[0].strip("`") for c in schema.split(", ")]
    fields = spark.createDataFrame([], schema).schema
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], to_arrow_schema(fields))
    return spark.createDataFrame(table)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a heavy projection over an input of few splits.

    A large table has more splits than the cluster has cores and is returned as it is, without a
    shuffle; only an input that would leave cores idle is redistributed.  Meant for plain scans: their
    number of splits is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
