"""Where intermediate tables live: the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.session import small_broadcasts


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster is told to set it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{os.getuid()}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, tag)
    with small_broadcasts(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote. Only for those that nothing still to be computed reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(conf).delete(path, True)


#: Rows of the batches that go to Python workers, where texts of any length pass through.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows if they are larger: executor and worker each hold whole batches. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return to the system what this process's allocators hold unused: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
