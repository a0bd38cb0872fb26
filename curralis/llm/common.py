"""Helpers that the text operators share: tables in the shared folder, and safe reading of inputs."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Most rows of whole texts that pass to Python at once, unless the session sets another number than Spark's default.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once: Spark's default of 10,000 rows is meant for rows of numbers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: The tables of words that operators keep in a Python worker from task to task, by operator.
_held: dict[str, dict] = {}


def holds(name: str, table: dict) -> dict:
    """Registers a table that a worker may keep between tasks of the operator of this name."""
    _held[name] = table
    return table


def lean(name: str, task):
    """task, a function over batches, that leaves a worker small: the tables of other operators are dropped before it, and free memory
    goes back to the system after it. Workers outlive stages, and an executor's memory is theirs and the JVM's together."""

    def run(batches):
        for other, table in _held.items():
            if other != name:
                table.clear()
        trim()
        try:
            yield from task(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Gives this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "curralis-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is ever written twice to the same one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    bound_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)
