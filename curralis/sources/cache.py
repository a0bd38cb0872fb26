"""Texts converted once per content: a folder of (digest, text), appended to, looked up by a digest of the content's bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest string, text string"


def content_digest(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of content."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


class DigestCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # nothing has been stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def texts(self, documents: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """documents (content binary, any others) with text; convert gets (digest, content) of contents not stored, each once, and returns (digest, text).

        What it returns is stored before it is used, so a lost executor converts nothing twice. A null content has a null text. Two
        writers may store one content twice; one of the texts is used.
        """
        keyed = documents.withColumn("digest", content_digest(F.col("content")))
        fresh = keyed.filter("digest IS NOT NULL").select("digest", "content").join(self.stored().select("digest"), "digest", "left_anti")
        new = fresh.groupBy("digest").agg(F.first("content").alias("content"))
        convert(new).select("digest", "text").write.mode("append").parquet(self.path)
        return keyed.join(self.stored().groupBy("digest").agg(F.min("text").alias("text")), "digest", "left")
