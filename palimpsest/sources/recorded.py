"""Recorded worlds: answers kept by the key of the term that they answer; and the file payload source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record(answers: DataFrame, path: str) -> None:
    """Append (key, term, answer) rows, partitioned by term."""
    answers.select("key", "term", "answer").write.mode("append").partitionBy("term").parquet(path)


def replay(calls: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """calls (key, term) with their answers; without one the outcome is NOT_RECORDED."""
    known = spark.read.schema("key string, answer string, term string").parquet(path).dropDuplicates(["key"])
    return calls.join(known.select("key", "answer"), "key", "left").withColumn("outcome", F.when(F.col("answer").isNull(), "NOT_RECORDED").otherwise("OK"))


def payloads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of the files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("content").cast("string").alias("text"))
