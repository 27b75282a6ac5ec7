"""A corpus made ready for training, in stages that each read what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirekit.llm.common import saved
from quirekit.llm.mixing import mixed_documents
from quirekit.llm.near_duplicates import without_near_duplicates
from quirekit.llm.packing import packed
from quirekit.llm.quality import good_documents
from quirekit.llm.secret_scan import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learned from labels, accepts."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in them masked."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics have their target weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the windows of the training steps."""
    return packed(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("secret scan", secrets), ("mixing", mixing), ("packing", packing)]

#: Neither the learned scores nor the signatures are for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
