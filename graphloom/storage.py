"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="graphloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and everything runs on one machine, as in tests, a folder of it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{_local_dir()}"


#: Bytes of input, as files hold them, that are worth a task, and tasks for each core that keep it busy.
TASK_BYTES, TASKS = 2 << 20, 4


def packed(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df in as many tasks as its size is worth: many tasks on little data make many small files. Partitions are put
    together as long as TASKS tasks are left for each core and their share of the input, by the optimizer's estimate for df,
    or for `of` that it comes from, stays under TASK_BYTES."""
    size = int((df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(TASKS * df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return df.coalesce(min(tasks, (1 << 31) - 1))


def written(df: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
    """Cuts lineage: df written to the shared folder, packed(), and read again. A lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    packed(df, of).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables in the shared folder, of all sessions that use it. Results that were not written
    elsewhere may still read them, so this is the caller's to decide."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
