"""As-of reads, interval joins and version tables."""

from pyspark.sql import functions as F

from palimpsest.operators import temporal as op
from palimpsest.registry import query
from palimpsest.sources import model as m

_VALID = f"valid_from <= TIMESTAMP '{m.T1}' AND (valid_to IS NULL OR TIMESTAMP '{m.T1}' < valid_to)"
_OBSERVED = f"observed_from <= TIMESTAMP '{m.KNOWN}' AND (observed_to IS NULL OR TIMESTAMP '{m.KNOWN}' < observed_to)"


@query(f"WITH {m.V} SELECT event_id, entity, state, value FROM v WHERE {_VALID}")
def asof_valid(spark, sf_dir):
    return op.as_of(m.versions(spark, sf_dir), m.at(m.T1)).select("event_id", "entity", "state", "value")


@query(f"WITH {m.V} SELECT event_id, entity, state, value FROM v WHERE {_VALID} AND {_OBSERVED}")
def asof_bitemporal(spark, sf_dir):
    return op.as_of(m.versions(spark, sf_dir), m.at(m.T1), m.at(m.KNOWN)).select("event_id", "entity", "state", "value")


@query(f"WITH {m.V} SELECT event_id, entity, state FROM v WHERE valid_from <= TIMESTAMP '{m.T2}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{m.T1}')")
def valid_in_window(spark, sf_dir):
    return m.versions(spark, sf_dir).where(op.valid_in(m.at(m.T1), m.at(m.T2))).select("event_id", "entity", "state")


@query(
    f"""WITH {m.E} SELECT x.edge_id, y.event_id, epoch_us(greatest(x.valid_from, y.valid_from)) AS common_from, epoch_us(least(x.valid_to, coalesce(y.valid_to, x.valid_to))) AS common_to
    FROM e x JOIN v y ON x.src = y.entity AND x.valid_from < coalesce(y.valid_to, TIMESTAMP '2999-01-01') AND y.valid_from < x.valid_to"""
)
def interval_overlap_join(spark, sf_dir):
    left = m.edges(spark, sf_dir).select("edge_id", F.col("src").alias("entity"), "valid_from", "valid_to")
    right = m.versions(spark, sf_dir).select("event_id", "entity", "valid_from", "valid_to")
    joined = op.interval_join(left, right, ["entity"], 6 * 3600, m.at("2024-03-01 00:00:00"))
    lo, hi = op.intersection(F.col("valid_from"), F.col("valid_to"), F.col("r_valid_from"), F.col("r_valid_to"))
    return joined.select("edge_id", F.col("r_event_id").alias("event_id"), m.micros(lo).alias("common_from"), m.micros(hi).alias("common_to"))


@query(
    f"""WITH {m.C}, p AS (SELECT change_id, target, start FROM c), r AS (SELECT event_id, entity, valid_from, state, value FROM a WHERE state <> 'error'),
    j AS (SELECT p.change_id, r.event_id, r.state, row_number() OVER (PARTITION BY p.change_id ORDER BY r.valid_from DESC, r.event_id DESC) AS rn
    FROM p LEFT JOIN r ON p.target = r.entity AND r.valid_from <= p.start) SELECT change_id, event_id, state FROM j WHERE rn = 1"""
)
def asof_join_latest(spark, sf_dir):
    points = m.changes(spark, sf_dir).select("change_id", F.col("target").alias("entity"), "start")
    rows = m.assertions(spark, sf_dir).where(F.col("state") != "error").select("event_id", "entity", "valid_from", "state")
    return op.asof_join(points, rows, "entity", "start", "valid_from", "event_id", ["event_id", "state"]).select("change_id", "event_id", "state")


@query(f"WITH {m.A} SELECT entity, event_id, state FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC, event_id DESC) AS rn FROM a WHERE valid_from <= TIMESTAMP '{m.T1}') x WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    return op.latest_before(m.assertions(spark, sf_dir), "entity", "valid_from", "event_id", m.at(m.T1)).select("entity", "event_id", "state")


@query(f"WITH {m.V} SELECT event_id, entity, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to FROM v")
def lead_valid_to(spark, sf_dir):
    return m.versions(spark, sf_dir).select("event_id", "entity", m.micros("valid_from").alias("valid_from"), m.micros("valid_to").alias("valid_to"))


@query(
    f"""WITH {m.V}, s AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY entity ORDER BY valid_from, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY valid_from, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT entity, state, epoch_us(min(valid_from)) AS valid_from, epoch_us(CASE WHEN count(valid_to) = count(*) THEN max(valid_to) END) AS valid_to, count(*) AS n_rows FROM g GROUP BY entity, run, state"""
)
def coalesce_islands(spark, sf_dir):
    out = op.islands(m.versions(spark, sf_dir), "entity", "state", ["valid_from", "event_id"])
    return out.select("entity", "state", m.micros("valid_from").alias("valid_from"), m.micros("valid_to").alias("valid_to"), "n_rows")


@query(
    f"""WITH {m.E}, o AS (SELECT *, max(valid_to) OVER (PARTITION BY src ORDER BY valid_from, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
    SELECT edge_id, src FROM o WHERE valid_from < reach"""
)
def overlap_invariant(spark, sf_dir):
    return op.overlapping(m.edges(spark, sf_dir), "src", ["valid_from", "edge_id"]).select("edge_id", "src")


@query(
    f"""WITH {m.V} SELECT event_id, epoch_us(valid_from) AS valid_from, epoch_us(CASE WHEN valid_from < TIMESTAMP '{m.T1}' AND (valid_to IS NULL OR TIMESTAMP '{m.T1}' < valid_to) THEN TIMESTAMP '{m.T1}' ELSE valid_to END) AS valid_to FROM v
    UNION ALL SELECT event_id, epoch_us(TIMESTAMP '{m.T1}'), epoch_us(valid_to) FROM v WHERE valid_from < TIMESTAMP '{m.T1}' AND (valid_to IS NULL OR TIMESTAMP '{m.T1}' < valid_to)"""
)
def interval_split(spark, sf_dir):
    rows = m.versions(spark, sf_dir).select("event_id", "valid_from", "valid_to")
    return op.split_at(rows, m.at(m.T1)).select("event_id", m.micros("valid_from").alias("valid_from"), m.micros("valid_to").alias("valid_to"))


@query(
    f"""WITH {m.V} SELECT event_id, epoch_us(least(coalesce(valid_to, TIMESTAMP '{m.T2}'), TIMESTAMP '{m.T2}')) AS clamped_to,
    CASE WHEN valid_from >= TIMESTAMP '{m.T2}' THEN 'past_horizon' WHEN valid_to IS NULL OR valid_to > TIMESTAMP '{m.T2}' THEN 'cut' ELSE 'whole' END AS status FROM v"""
)
def horizon_clamp(spark, sf_dir):
    horizon = m.at(m.T2)
    status = F.when(F.col("valid_from") >= horizon, "past_horizon").when(F.col("valid_to").isNull() | (F.col("valid_to") > horizon), "cut").otherwise("whole")
    return m.versions(spark, sf_dir).select("event_id", m.micros(F.least(F.coalesce("valid_to", horizon), horizon)).alias("clamped_to"), status.alias("status"))


@query(
    f"""WITH {m.V} SELECT entity, count(*) AS n, CASE WHEN min(valid_from) > TIMESTAMP '{m.T1}' THEN 'before_history' ELSE 'present' END AS status FROM v GROUP BY entity"""
)
def before_history_guard(spark, sf_dir):
    status = F.when(F.min("valid_from") > m.at(m.T1), "before_history").otherwise("present")
    return m.versions(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), status.alias("status"))


@query(
    f"""WITH {m.A} SELECT event_id, epoch_us(greatest(valid_from - INTERVAL 24 HOUR, valid_from - INTERVAL 6 HOUR)) AS narrowed_from, true AS truncated,
    CASE WHEN valid_from < TIMESTAMP '2024-01-05 00:00:00' THEN 'OUTSIDE_RETENTION' WHEN valid_from > TIMESTAMP '2024-01-30 23:00:00' THEN 'NOT_YET_INGESTED' ELSE 'OK' END AS outcome FROM a"""
)
def window_outcomes(spark, sf_dir):
    """A 24 h window before each event, narrowed to its last 6 h; retention and ingestion lag decide the outcome."""
    start, cap = F.col("valid_from") - m.hours(24), F.col("valid_from") - m.hours(6)
    outcome = F.when(F.col("valid_from") < m.at("2024-01-05 00:00:00"), "OUTSIDE_RETENTION").when(F.col("valid_from") > m.at("2024-01-30 23:00:00"), "NOT_YET_INGESTED").otherwise("OK")
    return m.assertions(spark, sf_dir).select("event_id", m.micros(F.greatest(start, cap)).alias("narrowed_from"), (start < cap).alias("truncated"), outcome.alias("outcome"))
