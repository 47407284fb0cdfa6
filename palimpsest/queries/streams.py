"""Streaming operators run over what is there, and their batch forms."""

from pyspark.sql import functions as F

from palimpsest.registry import query
from palimpsest.sources import model as m
from palimpsest.storage import shared_path
from palimpsest.streaming import topology as op

_SPANS = f"{m.A}, s AS (SELECT event_id, time_bucket(INTERVAL 5 MINUTE, valid_from) AS start, entity AS src, 'u' || (k % 10) AS dst, 1.0 / (1 + k % 4) AS p FROM a)"


def _spans(rows):
    return rows.select("event_id", F.col("valid_from").alias("ts"), F.col("entity").alias("src"), F.concat(F.lit("u"), F.col("k") % 10).alias("dst"), (1.0 / (1 + F.col("k") % 4)).alias("p"))


@query(f"WITH {_SPANS} SELECT epoch_us(start) AS start, src, dst, count(*) AS calls, CAST(round(sum(1 / p)) AS BIGINT) AS weight FROM s GROUP BY 1, 2, 3")
def stream_topology_batch(spark, sf_dir):
    """The batch form: what the stream tells once all windows are closed."""
    return op.windowed_calls(_spans(m.assertions(spark, sf_dir))).withColumn("start", m.micros("start"))


@query(f"WITH {_SPANS} SELECT epoch_us(start) AS start, src, dst, count(*) AS calls, CAST(round(sum(1 / p)) AS BIGINT) AS weight FROM s GROUP BY 1, 2, 3")
def stream_topology(spark, sf_dir):
    """The same through Structured Streaming alone: a heartbeat behind the last span closes the windows that are open at the end."""
    raw = _raw(spark, sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    spans = _spans(raw.select("event_id", F.col("ts").cast("timestamp").alias("valid_from"), F.concat(F.lit("u"), "user_id").alias("entity"), k.alias("k")))
    beats = shared_path(spark, "heartbeat")
    op.heartbeat(spark, m.at("2030-01-01 00:00:00"), spans).write.parquet(beats)
    both = spans.unionByName(spark.readStream.schema(spans.schema).parquet(beats))
    return op.run_available(op.windowed_calls(both), shared_path(spark, "stream")).withColumn("start", m.micros("start"))


def _raw(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


_DAYS = f"{m.A}, d AS (SELECT entity AS key, CAST(floor(epoch(valid_from) / 86400) AS BIGINT) AS win, CAST(least(5, count(*)) AS INTEGER) AS class FROM a GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY win) AS n FROM d)"


@query(
    f"""WITH RECURSIVE {_DAYS}, w AS (SELECT key, n, -1 AS now, class AS pending, win AS since, win AS last, NULL::VARCHAR AS k1, 0 AS c1, 0::BIGINT AS w1, NULL::VARCHAR AS k2, 0 AS c2, 0::BIGINT AS w2 FROM o WHERE n = 1
    UNION ALL SELECT key, n, CASE WHEN class <> eff AND class = pend THEN class ELSE eff END, CASE WHEN class = eff OR class = pend THEN -1 ELSE class END, CASE WHEN class = eff OR class = pend THEN since ELSE win END, win,
    CASE WHEN gone THEN 'retract' END, now, last + 1, CASE WHEN class <> eff AND class = pend THEN 'set' END, class, since FROM (SELECT w.key, o.n, w.now, o.class, o.win, w.since, w.last, o.win - w.last > 6 AND w.now >= 0 AS gone, CASE WHEN o.win - w.last > 6 AND w.now >= 0 THEN -1 ELSE w.now END AS eff, CASE WHEN o.win - w.last > 6 AND w.now >= 0 THEN -1 ELSE w.pending END AS pend FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1) q),
    e AS (SELECT key, k1 AS kind, c1 AS class, w1 AS win FROM w WHERE k1 IS NOT NULL UNION ALL SELECT key, k2, c2, w2 FROM w WHERE k2 IS NOT NULL), z AS (SELECT key, arg_max(now, n) AS now, max(last) AS last FROM w GROUP BY 1)
    SELECT * FROM e UNION ALL SELECT key, 'retract', now, last + 1 FROM z WHERE now >= 0"""
)
def stream_edge_events(spark, sf_dir):
    """Hysteresis and absence with state, as a stream over each key's daily windows. At the end time goes on, and what isn't seen any more is retracted by its timer."""
    day = F.floor(F.unix_seconds("valid_from") / 86400).cast("long")
    daily = m.assertions(spark, sf_dir).groupBy(F.col("entity").alias("key"), day.alias("window")).agg(F.least(F.lit(5), F.count(F.lit(1))).cast("int").alias("class"))
    path = shared_path(spark, "stream")
    daily.write.parquet(f"{path}/in")
    beat = spark.range(1).select(F.lit("").alias("key"), F.lit(40_000).cast("long").alias("window"), F.lit(0).alias("class"))
    beat.write.parquet(f"{path}/beat")
    rows = spark.readStream.schema(daily.schema).parquet(f"{path}/in").unionByName(spark.readStream.schema(daily.schema).parquet(f"{path}/beat"))
    own = rows.withColumn("at", F.timestamp_seconds(F.col("window") * 86400)).withWatermark("at", "0 seconds")
    return op.run_available(op.edge_events(own, 86400), path).withColumnRenamed("window", "win").where("key <> ''")


@query(f"WITH {m.A} SELECT event_id, entity, state FROM a")
def stream_redelivery(spark, sf_dir):
    """A stream with every tenth event delivered twice: each comes out once."""
    raw = _raw(spark, sf_dir).select("event_id", F.concat(F.lit("u"), "user_id").alias("entity"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"))
    twice = raw.withColumn("delivery", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return op.run_available(op.deduplicated(twice, "event_id", "ts", "40 days"), shared_path(spark, "stream")).select("event_id", "entity", "state")


@query(f"WITH {m.A}, o AS (SELECT entity AS key, valid_from AS tm, source AS print, lag(source) OVER (PARTITION BY entity ORDER BY valid_from, source) AS old FROM a) SELECT key, old, print AS new, epoch_us(tm) AS at FROM o WHERE print IS DISTINCT FROM old")
def stream_changes(spark, sf_dir):
    """What a stream tells of each entity's version: the first, and every change."""
    raw = _raw(spark, sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = raw.select(F.concat(F.lit("u"), "user_id").alias("key"), F.concat(F.lit("s"), k % 3).alias("fingerprint"), F.col("ts").cast("timestamp").alias("at"))
    return op.run_available(op.changed_only(rows), shared_path(spark, "stream")).withColumn("at", m.micros("at"))
