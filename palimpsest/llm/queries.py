"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.fingerprints import compare_with_edits

    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1, size=4096)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.neighbours import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=40)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.mixing import mixed_sizes

    return mixed_sizes(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.toxicity import toxic_scores

    return toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_packing, op4_jaccard, op5_neighbours, op6_sharding, op7_licenses, op8_line_dedup, op9_mixing, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    from palimpsest.llm import oracles

    return {"op4_jaccard": oracles.JACCARD, "op7_licenses": oracles.LICENSES, "op8_line_dedup": oracles.LINES}
