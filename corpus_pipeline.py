"""From raw documents to token ids: five stages, each over all that the one before it kept.

Null texts count as empty; long texts are read whole; repeated rows are documents of their own, unless a stage says
otherwise. All stages but the last return every column of their input, whatever its name. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import written
from graphloom.llm.exact_dedup import keep_copies
from graphloom.llm.jaccard import keep_one_each
from graphloom.llm.mixing import mixed
from graphloom.llm.pieces import default_model, encode_documents
from graphloom.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; null and empty texts are scored as texts without words, repeated rows alike."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; nulls and empty ones are equal) one row stays, that of the largest doc_id.

    Rows that repeat doc_id and text: the one that is least as JSON.
    """
    return keep_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least doc_id stays; texts without words, and nulls, all stay.

    Rows that repeat doc_id and text are one document here.
    """
    return keep_one_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it: 0 to 3 times. Texts without words, and nulls, stay once."""
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row, repeated rows each; an empty text has the begin and end ids only."""
    return encode_documents(docs, default_model())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Learned scores, similarity joins, random rounding and subword merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
