"""Session helpers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster without that path, ship it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes, as Spark reckons them, that a join of an intermediate step may send whole to the driver and all executors.
SENT = 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, joins send at most SENT bytes whole, or less if the session says so; then the session's own limit holds again.

    Spark reckons a table by its files, which columns and repeated values fill many times over in memory, and an exploded array by
    its one entry; the driver holds what is sent of each step until it collects its garbage.
    """
    key, now = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() <= SENT:
        yield
        return
    spark.conf.set(key, str(SENT))
    try:
        yield
    finally:
        spark.conf.set(key, now)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the folder that spark.checkpoint.dir names and read it back, so that lineage ends here. A local master without one gets a folder of its own."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file:///tmp/checkpoints/{os.getuid()}"
    path = f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    with small_broadcasts(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that `written` wrote. Only for those that nothing still to be computed reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
