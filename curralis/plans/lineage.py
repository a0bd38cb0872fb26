"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "curralis-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Parts in which one class or edge type is written, so that a large one is no single task's.
PARTS = 16


def dealt(df: DataFrame, by: str, key: str) -> DataFrame:
    """df dealt out for a write partitioned by a column of few values: each value in up to PARTS tasks."""
    return df.repartition(F.col(by), F.pmod(F.xxhash64(key), F.lit(PARTS)))


def settled(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the checkpoint folder: lost executors lose nothing, and later plans start from it.

    A table is written by one job, where checkpoint() computes its plan a second time to write it.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """settled(df), and the number of its rows (or of those for which what holds), observed by the job that writes it."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("n") if what is None else F.count_if(what).alias("n")))
    return out, seen.get["n"]
