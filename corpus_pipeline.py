"""A corpus pipeline of five stages. Each takes all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import shared_path
from palimpsest.llm.jaccard import one_of_each
from palimpsest.llm.line_dedup import cleaned_documents
from palimpsest.llm.mixing import mixed_documents
from palimpsest.llm.packing import pack
from palimpsest.llm.toxicity import clean_documents
from palimpsest.session import ready


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. It is fitted on the labelled documents among docs."""
    ready(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many sites stay in one document; documents of which nothing else is left go."""
    return cleaned_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest doc_id stays."""
    ready(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: each document stays as often as its source's rate says, none to two times."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and its place there."""
    ready(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, size=4096)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

#: A fitted model, sketches and a tokenizer: no SQL says this.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
