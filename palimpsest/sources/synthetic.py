"""Deterministic generators: series, logs and a power-law graph from hashes of a seed and a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *of: str) -> Column:
    """A number in [0, 1) that depends on a seed and columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def series(spark: SparkSession, entities: int, minutes: int, seed: int = 1) -> DataFrame:
    """entity, at, value: a daily wave with 4 % noise."""
    rows = spark.range(entities * minutes).select((F.col("id") % entities).alias("entity"), (F.floor(F.col("id") / entities) * 60).alias("at"))
    wave = 100 + 30 * F.sin(F.col("at") * 2 * 3.141592653589793 / 86400)
    return rows.withColumn("value", F.round(wave * (0.96 + 0.08 * uniform(seed, "entity", "at")), 6))


def graph(spark: SparkSession, nodes: int, edges: int, seed: int = 1, skew: float = 3.0) -> DataFrame:
    """edge_id, src, dst: sources even, targets crowding towards small ids by a power law."""
    rows = spark.range(edges).withColumnRenamed("id", "edge_id")
    return rows.select("edge_id", F.floor(uniform(seed, "edge_id") * nodes).alias("src"), F.floor(F.pow(uniform(seed + 1, "edge_id"), F.lit(skew)) * nodes).alias("dst"))


def logs(spark: SparkSession, lines: int, seed: int = 1) -> DataFrame:
    """line_id, text, status."""
    rows = spark.range(lines).withColumnRenamed("id", "line_id").withColumn("u", uniform(seed, "line_id"))
    status = F.when(F.col("u") < 0.05, "error").otherwise("info")
    return rows.select("line_id", F.concat(F.lit("GET /orders/"), F.floor(F.col("u") * 10000), F.lit(" in "), F.floor(F.col("u") * 900), F.lit("ms")).alias("text"), status.alias("status"))
