"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

run(spark, sf_dir) applies STAGES to the table documents. Each stage works on all rows that the one before it kept.

Defined cases, as in the operators: rows without doc_id or text go through all stages; repeated rows and ties stand or fall together; texts of
any length are judged whole; empty tables give empty results; all columns of documents stay as they are, whatever their names, but
for text, in which the PII stage replaces entities. The last stage returns pieces with their token ids and places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curralis.llm import exact_dedup, near_dedup, packing, pii, quality
from curralis.llm.common import table, written

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.7
#: The session's setting that holds the key of the surrogates, and the key where it is unset (tests): set your own secret.
PII_SETTING, PII_KEY = "spark.curralis.pii.key", "corpus-pipeline"


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.QualityModel.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    score = _free("score", docs)
    return model.score(docs, score).filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, width=5, num=80, den=100)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, spark.conf.get(PII_SETTING, PII_KEY), _free("n_entities", docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)[0]


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, MinHash and keyed surrogates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
