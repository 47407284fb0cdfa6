"""The star tables as the engine's model: assertions, versions, edges and changes, derived by fixed rules.

The same rules as SQL (A, V, E, C below) feed the oracles: each is a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Two valid instants and one observed instant that the queries use.
T1, T2, KNOWN = "2024-01-10 00:00:00", "2024-01-12 00:00:00", "2024-01-20 00:00:00"

A = """a AS (SELECT event_id, 'u' || user_id AS entity, user_id, 's' || (k % 3) AS source, event_type AS state, value, ts AS valid_from,
 ts + CASE WHEN k % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS observed_from, k
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) x)"""
V = (
    A
    + """, v AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity ORDER BY valid_from, event_id) AS valid_to,
 CASE WHEN k % 7 = 0 THEN observed_from + INTERVAL 2 DAY END AS observed_to FROM a)"""
)
E = (
    V
    + """, e AS (SELECT event_id AS edge_id, entity AS src, 'u' || ((user_id + 1 + k % 7) % 100) AS dst,
 CASE k % 4 WHEN 0 THEN 'runs_on' WHEN 1 THEN 'depends_on' ELSE 'calls' END AS type,
 CASE WHEN k % 4 >= 2 THEN k % 6 END AS weight_class, valid_from, valid_from + CASE WHEN k % 2 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 36 HOUR END AS valid_to,
 observed_from, observed_to FROM v)"""
)
C = A + ", c AS (SELECT event_id AS change_id, entity AS target, valid_from AS start, observed_from, k, value FROM a WHERE state = 'error')"


def at(instant: str) -> Column:
    return F.lit(instant).cast("timestamp")


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, entity, user_id, source, state, value, valid_from, observed_from, k: one row an event."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    late = F.when(F.col("k") % 5 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    events = table(spark, sf_dir, "events").withColumn("k", k).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("entity"), "user_id", F.concat(F.lit("s"), F.col("k") % 3).alias("source"), F.col("event_type").alias("state"),
        "value", F.col("ts").alias("valid_from"), (F.col("ts") + late).alias("observed_from"), "k",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assertions with valid_to (the entity's next valid_from) and observed_to."""
    order = Window.partitionBy("entity").orderBy("valid_from", "event_id")
    own = assertions(spark, sf_dir).withColumn("valid_to", F.lead("valid_from").over(order))
    return own.withColumn("observed_to", F.when(F.col("k") % 7 == 0, F.col("observed_from") + F.expr("INTERVAL 2 DAYS")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst, type, weight_class, valid_from, valid_to, observed_from, observed_to."""
    kind = F.when(F.col("k") % 4 == 0, "runs_on").when(F.col("k") % 4 == 1, "depends_on").otherwise("calls")
    lasts = F.when(F.col("k") % 2 == 0, hours(12)).otherwise(hours(36))
    return versions(spark, sf_dir).select(
        F.col("event_id").alias("edge_id"), F.col("entity").alias("src"), F.concat(F.lit("u"), (F.col("user_id") + 1 + F.col("k") % 7) % 100).alias("dst"), kind.alias("type"),
        F.when(F.col("k") % 4 >= 2, F.col("k") % 6).alias("weight_class"), "valid_from", (F.col("valid_from") + lasts).alias("valid_to"), "observed_from", "observed_to",
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, namespace, value, source, environment, name, owner: one identity claim an entity."""
    own = assertions(spark, sf_dir).select("entity", "user_id").distinct()
    i = F.col("user_id")
    return own.select(
        "entity", F.lit("host").alias("namespace"), F.concat(F.lit("h"), i % 39).alias("value"), F.concat(F.lit("src"), i % 2).alias("source"),
        F.when(i % 3 == 0, "prod").when(i % 3 == 1, "dev").otherwise("").alias("environment"), F.concat(F.lit("svc"), i % 7).alias("name"), F.concat(F.lit("n"), i % 5).alias("owner"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """change_id, target, start, observed_from, k, value: the errors."""
    return assertions(spark, sf_dir).where(F.col("state") == "error").select(F.col("event_id").alias("change_id"), F.col("entity").alias("target"), F.col("valid_from").alias("start"), "observed_from", "k", "value")
