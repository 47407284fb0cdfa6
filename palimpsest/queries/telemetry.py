"""Telemetry queries over events."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import telemetry as op
from palimpsest.registry import query
from palimpsest.sources import model as m

_BASE = f"valid_from < TIMESTAMP '{m.T1}'"
_SYM = f"valid_from >= TIMESTAMP '{m.T1}' AND valid_from < TIMESTAMP '{m.T2}'"


@query(
    f"""WITH {m.A}, q AS (SELECT entity, round(avg(value) FILTER (WHERE {_BASE}), 6) AS baseline, round(avg(value) FILTER (WHERE {_SYM}), 6) AS symptom FROM a GROUP BY 1),
    d AS (SELECT *, CASE WHEN baseline = 0 THEN 0 ELSE round((symptom - baseline) / baseline, 6) END AS delta FROM q WHERE baseline IS NOT NULL AND symptom IS NOT NULL)
    SELECT *, CASE WHEN delta > 0.1 THEN 'up' WHEN delta < -0.1 THEN 'down' ELSE 'flat' END AS direction, abs(delta) >= 0.2 AS separable FROM d"""
)
def compare(spark, sf_dir):
    t = F.col("valid_from")
    return op.compare(m.assertions(spark, sf_dir), "entity", t < m.at(m.T1), (t >= m.at(m.T1)) & (t < m.at(m.T2)), "value")


@query(f"WITH {m.A}, q AS (SELECT 'v' || (k % 10) AS version, count(*) FILTER (WHERE state = 'error') AS errors, count(*) AS total, epoch_us(min(valid_from)) AS first_seen FROM a GROUP BY 1) SELECT *, round(errors / total, 6) AS rate FROM q")
def errors_by_version(spark, sf_dir):
    rows = m.assertions(spark, sf_dir).withColumn("version", F.concat(F.lit("v"), F.col("k") % 10)).withColumn("at", m.micros("valid_from"))
    return op.errors_by(rows, "version", F.col("state") == "error", "at")


@query(
    f"""WITH {m.A}, q AS (SELECT 'v' || (k % 10) AS version, round(count(*) FILTER (WHERE state = 'error') / count(*), 6) AS rate FROM a GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY rate DESC, version) AS n FROM q)
    SELECT (SELECT version FROM r WHERE n = 1) AS top, (SELECT rate FROM r WHERE n = 1) AS high, (SELECT rate FROM r WHERE n = 2) AS next, (SELECT rate FROM r WHERE n = 1) >= 2 * (SELECT rate FROM r WHERE n = 2) AS concentrated"""
)
def concentration(spark, sf_dir):
    return op.concentrated(errors_by_version(spark, sf_dir), "rate", "version")


@query(
    f"""WITH {m.A}, q AS (SELECT source, 'op' || (k % 5) AS operation, list_sort(list(value)) AS s, count(*) AS n FROM a WHERE state = 'error' GROUP BY 1, 2)
    SELECT source, operation, n, s[CAST(floor(round(0.5 * (n - 1), 6) + 0.5) AS INTEGER) + 1] AS p50, s[CAST(floor(round(0.95 * (n - 1), 6) + 0.5) AS INTEGER) + 1] AS p95, s[CAST(floor(round(0.99 * (n - 1), 6) + 0.5) AS INTEGER) + 1] AS p99 FROM q"""
)
def error_spans(spark, sf_dir):
    """Error spans by source and operation, with nearest-rank latencies."""
    rows = m.assertions(spark, sf_dir).where("state = 'error'").groupBy("source", F.concat(F.lit("op"), F.col("k") % 5).alias("operation"))
    out = rows.agg(F.collect_list("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return out.select("source", "operation", "n", *(op.nearest_rank(F.col("s"), q).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)))


@query(
    f"""WITH {m.A}, t AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY valid_from, event_id) AS previous FROM a)
    SELECT entity, event_id, previous, state FROM t WHERE state IS DISTINCT FROM previous"""
)
def monitor_state(spark, sf_dir):
    return op.transitions(m.assertions(spark, sf_dir), "entity", ["valid_from", "event_id"]).select("entity", "event_id", "previous", "state")


_HOURLY = f"""{m.A}, h AS (SELECT entity, CAST(floor(epoch(valid_from) / 3600) AS BIGINT) * 3600 AS hour, round(avg(value), 6) AS value FROM a GROUP BY 1, 2)"""


def _hourly(spark, sf_dir):
    at = F.floor(F.unix_seconds("valid_from") / 3600) * 3600
    return m.assertions(spark, sf_dir).groupBy("entity", at.cast("long").alias("hour")).agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"WITH {_HOURLY}, p AS (SELECT entity, hour + 86400 * unnest([1, 2, 3]) AS hour, value AS past FROM h), b AS (SELECT entity, hour, median(past) AS baseline FROM p GROUP BY 1, 2) SELECT h.entity, h.hour, h.value, round(b.baseline, 6) AS baseline FROM h LEFT JOIN b USING (entity, hour)")
def seasonal_baseline(spark, sf_dir):
    out = op.seasonal_baseline(_hourly(spark, sf_dir), "entity", "hour", "value", 86_400)
    return out.select("entity", "hour", "value", F.round("baseline", 6).alias("baseline"))


@query()
def onset(spark, sf_dir):
    """Per state, the hourly mean with a step of 500 put in from half time on: every series has an onset."""
    at = F.floor(F.unix_seconds("valid_from") / 3600) * 3600
    rows = m.assertions(spark, sf_dir).groupBy("state", at.cast("long").alias("at")).agg(F.avg("value").alias("v"))
    return op.onset(rows.withColumn("v", F.col("v") + F.when(F.col("at") >= 1705320000, 500).otherwise(0)), "state", "at", "v")


@query(f"WITH {m.A} SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, valid_from)) AS start, entity AS src, 'u' || ((user_id + 1 + k % 7) % 100) AS dst, CAST(round(sum(1.0 / (1 + k % 4))) AS BIGINT) AS calls, max(source) AS host FROM a GROUP BY 1, 2, 3")
def topology_window(spark, sf_dir):
    """Calls per five-minute window, weighed by the inverse of the sampling probability."""
    dst = F.concat(F.lit("u"), (F.col("user_id") + 1 + F.col("k") % 7) % 100)
    rows = m.assertions(spark, sf_dir).withColumn("dst", dst).groupBy(F.window("valid_from", "5 minutes").alias("w"), F.col("entity").alias("src"), "dst")
    return rows.agg(F.round(F.sum(1.0 / (1 + F.col("k") % 4))).cast("long").alias("calls"), F.max("source").alias("host")).select(m.micros("w.start").alias("start"), "src", "dst", "calls", "host")


_DAILY = f"{m.A}, d AS (SELECT entity, CAST(floor(epoch(valid_from) / 86400) AS BIGINT) AS day, least(5, count(*)) AS class FROM a GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    day = F.floor(F.unix_seconds("valid_from") / 86400).cast("long")
    return m.assertions(spark, sf_dir).groupBy("entity", day.alias("day")).agg(F.least(F.lit(5), F.count(F.lit(1))).alias("class"))


@query(f"WITH {_DAILY}, f AS (SELECT *, lead(class) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY entity ORDER BY day)), g AS (SELECT * FROM f WHERE nxt = class), b AS (SELECT *, lag(class) OVER (PARTITION BY entity ORDER BY day) AS before FROM g) SELECT entity, day, class FROM b WHERE class IS DISTINCT FROM before")
def hysteresis(spark, sf_dir):
    return op.hysteresis(_daily(spark, sf_dir), "entity", "day").select("entity", "day", "class")


@query(f"WITH {_DAILY} SELECT entity, max(day) AS last_seen, max(day) + 1 AS valid_end FROM d WHERE day < 19740 GROUP BY 1 HAVING 19745 - max(day) >= 6")
def absence_retraction(spark, sf_dir):
    return op.absent(_daily(spark, sf_dir).where("day < 19740"), "entity", "day", F.lit(19745)).select("entity", "last_seen", "valid_end")


@query(f"WITH {m.A}, w AS (SELECT event_id, entity, source AS version, lag(source) OVER (PARTITION BY entity ORDER BY valid_from, event_id) AS previous FROM a) SELECT event_id, entity, previous, version FROM w WHERE previous IS NOT NULL AND previous <> version")
def version_rollouts(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("valid_from", "event_id")
    rows = m.assertions(spark, sf_dir).select("event_id", "entity", F.col("source").alias("version"), F.lag("source").over(w).alias("previous"))
    return rows.where("previous IS NOT NULL AND previous <> version")


@query(f"WITH {m.A}, t AS (SELECT entity, source AS version, sum(k) AS hits FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY hits DESC, version DESC) AS n FROM t) SELECT entity, version, hits FROM r WHERE n = 1")
def dominant_version(spark, sf_dir):
    """Most hits; the larger version on a tie."""
    hits = m.assertions(spark, sf_dir).groupBy("entity", F.col("source").alias("version")).agg(F.sum("k").alias("hits"))
    return hits.groupBy("entity").agg(F.max(F.struct("hits", "version")).alias("m")).select("entity", "m.version", "m.hits")


@query(f"WITH {m.A} SELECT entity, CAST(floor(epoch(valid_from) / 21600) AS BIGINT) * 21600 AS window, round(avg(value), 6) AS value, count(*) AS n FROM a GROUP BY 1, 2".replace("AS window,", 'AS "window",'))
def alignment(spark, sf_dir):
    """Series downsampled to six hours."""
    return op.aligned(m.assertions(spark, sf_dir), "entity", "valid_from", "value", 21600)


@query(f"WITH {m.A} SELECT entity, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least FROM a GROUP BY 1")
def series_stats(spark, sf_dir):
    return op.series_stats(m.assertions(spark, sf_dir), "entity", "value")


@query(f"WITH {m.A}, c AS (SELECT entity, avg(value) FILTER (WHERE k < 50) AS before, avg(value) FILTER (WHERE k >= 50) AS after, count(*) FILTER (WHERE k < 50) > 3 AS separable FROM a GROUP BY 1) SELECT entity, round((before - after) / before, 6) AS fall FROM c WHERE separable AND after < before AND round((before - after) / before, 6) >= 0.5")
def stopped_flows(spark, sf_dir):
    a, low = m.assertions(spark, sf_dir), F.col("k") < 50
    compared = a.groupBy("entity").agg(F.avg(F.when(low, F.col("value"))).alias("before"), F.avg(F.when(~low, F.col("value"))).alias("after"), (F.count_if(low) > 3).alias("separable"))
    return op.stopped_flows(compared).select("entity", "fall")


@query(f"WITH {m.A}, s AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY valid_from, event_id) AS old FROM a WHERE valid_from < TIMESTAMP '{m.T2}') SELECT entity, arg_max(state, (valid_from, event_id)) FILTER (WHERE valid_from < TIMESTAMP '{m.T1}') AS at_start, arg_max(state, (valid_from, event_id)) AS at_end, count(*) FILTER (WHERE valid_from >= TIMESTAMP '{m.T1}' AND state IS DISTINCT FROM old) AS transitions FROM s GROUP BY 1")
def state_spans(spark, sf_dir):
    """A monitor's state at the start and end of a window, and its changes inside."""
    return op.state_spans(m.assertions(spark, sf_dir), "entity", "valid_from", m.at(m.T1), m.at(m.T2))


@query("WITH r AS (SELECT event_id, epoch(ts) AS e, (event_id % 9 - 2) * 600 AS l FROM events), h AS (SELECT event_id, least(e, 1705000000.0) AS t, CASE WHEN l > 0 THEN least(l / 2, 1800) ELSE 900 END AS w FROM r) SELECT event_id, round(t - 2 * w, 3) AS baseline_from, round(t - w, 3) AS symptom_from, round(t, 3) AS symptom_to FROM h")
def compare_windows(spark, sf_dir):
    """Windows of a comparison, slid back to what the log has."""
    rows = m.table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("e"), ((F.col("event_id") % 9 - 2) * 600).alias("l"))
    found = op.compare_windows(rows, F.col("e"), F.col("l"), F.lit(1705000000.0))
    return found.select("event_id", *(F.round(c, 3).alias(c) for c in ("baseline_from", "symptom_from", "symptom_to")))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return op.latency(m.table(spark, sf_dir, "events"), "event_type", "value")


@query(f"WITH {m.A} SELECT source, 'kind' || (k % 3) AS kind, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM a WHERE state = 'error' GROUP BY 1, 2")
def error_kinds(spark, sf_dir):
    rows = m.assertions(spark, sf_dir).where("state = 'error'").withColumn("kind", F.concat(F.lit("kind"), F.col("k") % 3))
    return op.error_kinds(rows, "source", "kind", "value")


@query(f"WITH {m.A}, d AS (SELECT DISTINCT entity, valid_from FROM a), g AS (SELECT entity, CAST(floor(epoch(valid_from)) AS BIGINT) - CAST(floor(epoch(lag(valid_from) OVER (PARTITION BY entity ORDER BY valid_from))) AS BIGINT) AS g FROM d) SELECT entity, quantile_disc(g, 0.5) AS resolution FROM g WHERE g IS NOT NULL GROUP BY 1")
def median_gaps(spark, sf_dir):
    return op.median_gaps(m.assertions(spark, sf_dir), "entity", "valid_from")
