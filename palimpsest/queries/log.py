"""Event log queries."""

from pyspark.sql import functions as F

from palimpsest.registry import query
from palimpsest.sources import log as op
from palimpsest.sources import model as m
from palimpsest.sources.model import table

_TWICE = f"WITH {m.A}, d AS (SELECT event_id, entity, state, value, 1 AS arrival FROM a UNION ALL SELECT event_id, entity, state, CASE WHEN event_id % 20 = 0 THEN value + 1 ELSE value END, 2 FROM a WHERE event_id % 10 = 0)"


def _twice(spark, sf_dir):
    own = m.assertions(spark, sf_dir).select("event_id", "entity", "state", "value", F.lit(1).alias("arrival"))
    again = own.where("event_id % 10 = 0").withColumn("value", F.when(F.col("event_id") % 20 == 0, F.col("value") + 1).otherwise(F.col("value"))).withColumn("arrival", F.lit(2))
    return own.unionByName(again)


@query(_TWICE + " SELECT event_id, entity, state, value FROM d WHERE arrival = 1")
def log_dedupe(spark, sf_dir):
    rows = _twice(spark, sf_dir)
    payload = F.concat_ws("|", "entity", "state", F.col("value").cast("string"))
    return op.deliveries(rows, "event_id", ["arrival"], payload).where("delivery = 1").select("event_id", "entity", "state", "value")


@query(_TWICE + ", f AS (SELECT d.*, first_value(value) OVER (PARTITION BY event_id ORDER BY arrival) AS v1 FROM d) SELECT event_id, value <> v1 AS payload_differs FROM f WHERE arrival > 1")
def duplicate_report(spark, sf_dir):
    payload = F.concat_ws("|", "entity", "state", F.col("value").cast("string"))
    return op.deliveries(_twice(spark, sf_dir), "event_id", ["arrival"], payload).where("delivery > 1").select("event_id", "payload_differs")


@query(_TWICE + " SELECT count(*) AS n FROM d WHERE arrival = 2 AND event_id % 40 = 0")
def log_append_new(spark, sf_dir):
    """Of a second batch, the rows that a log without every fortieth event lacks."""
    rows = _twice(spark, sf_dir)
    log = rows.where("arrival = 1 AND event_id % 40 <> 0")
    return op.append(log, rows.where("arrival = 2"), "event_id", ["arrival"]).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {m.A} SELECT event_id, CASE WHEN state NOT IN ('view', 'click', 'purchase', 'error') THEN 'unknown_type' WHEN observed_from < valid_from THEN 'observed_before_valid' END AS reason
    FROM a WHERE state NOT IN ('view', 'click', 'purchase', 'error')"""
)
def reject_report(spark, sf_dir):
    rows = m.assertions(spark, sf_dir)
    reason = op.rejection(F.col("event_id"), F.col("state"), ["view", "click", "purchase", "error"], F.col("valid_from"), F.col("observed_from"), F.lit("{}"))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("event_id", "reason")


@query(f"WITH {m.A} SELECT event_id, entity, state FROM a WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def log_page(spark, sf_dir):
    return op.page(m.assertions(spark, sf_dir), 500, 100).select("event_id", "entity", "state")


@query(f"WITH {m.A} SELECT event_id, entity, state FROM a WHERE source = 's1'")
def log_by_source(spark, sf_dir):
    return m.assertions(spark, sf_dir).where("source = 's1'").select("event_id", "entity", "state")


@query(f"WITH {m.A} SELECT event_id, state FROM a WHERE observed_from >= TIMESTAMP '{m.T1}' AND observed_from < TIMESTAMP '{m.T2}'")
def log_by_observed_range(spark, sf_dir):
    return m.assertions(spark, sf_dir).where((F.col("observed_from") >= m.at(m.T1)) & (F.col("observed_from") < m.at(m.T2))).select("event_id", "state")


@query(f"WITH {m.A} SELECT epoch_us(min(observed_from)) AS extent_from, epoch_us(max(observed_from)) AS extent_to, count(*) AS n FROM a")
def extent(spark, sf_dir):
    return op.extent(m.assertions(spark, sf_dir)).select(m.micros("extent_from").alias("extent_from"), m.micros("extent_to").alias("extent_to"), "n")


_CHECKPOINTS = f"""WITH {m.A}, k AS (SELECT source, event_id AS seq, CASE WHEN k % 3 <> 1 THEN observed_from END AS extent_to, k % 10 = 0 AS gap FROM a)"""


@query(
    _CHECKPOINTS
    + """, g AS (SELECT *, last_value(extent_to IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_from FROM k)
    SELECT source, seq, epoch_us(gap_from) AS gap_from FROM g WHERE gap"""
)
def extent_gaps(spark, sf_dir):
    points = m.assertions(spark, sf_dir).select("source", F.col("event_id").alias("seq"), F.when(F.col("k") % 3 != 1, F.col("observed_from")).alias("extent_to"), (F.col("k") % 10 == 0).alias("gap"))
    return op.gaps(points).select("source", "seq", m.micros("gap_from").alias("gap_from"))


@query(f"WITH {m.A} SELECT event_id, CASE WHEN k % 4 = 0 THEN 'key-' || event_id WHEN state = 'error' THEN 'alert-' || entity || '-' || event_id ELSE CAST(event_id AS VARCHAR) END AS idempotency_key FROM a")
def idempotency_key(spark, sf_dir):
    explicit = F.when(F.col("k") % 4 == 0, F.concat(F.lit("key-"), "event_id"))
    alert = F.when(F.col("state") == "error", F.concat(F.lit("alert-"), "entity", F.lit("-"), "event_id"))
    return m.assertions(spark, sf_dir).select("event_id", op.idempotency_key(explicit, alert, F.col("event_id")).alias("idempotency_key"))


_N = "n AS (SELECT o_orderkey AS i, o_orderkey % 17 AS k FROM orders)"
_ENVELOPE = """e AS (SELECT i, k, CASE WHEN k = 0 THEN NULL ELSE i END AS event_id, CASE k WHEN 4 THEN 'retract_node' WHEN 6 THEN 'identity_claim' WHEN 7 THEN 'record_investigation' WHEN 11 THEN 'upsert_edge' WHEN 12 THEN 'confirm_merge' WHEN 13 THEN 'confirm_merge' WHEN 14 THEN 'retract_edge' WHEN 2 THEN 'nothing' ELSE 'upsert_node' END AS type FROM n)"""


@query(
    f"""WITH {_N}, {_ENVELOPE} SELECT i, CASE k WHEN 0 THEN 'missing_event_id' WHEN 1 THEN 'missing_source' WHEN 2 THEN 'untyped' WHEN 3 THEN 'unknown_schema_version' WHEN 4 THEN 'missing_ref' WHEN 5 THEN 'unknown_type' WHEN 6 THEN 'correlation_as_identity' WHEN 7 THEN 'prop_namespace' WHEN 8 THEN 'secret_value'
    WHEN 9 THEN 'telemetry_payload' WHEN 10 THEN 'telemetry_payload' WHEN 11 THEN 'missing_ref' WHEN 12 THEN 'missing_principal' WHEN 14 THEN 'ref_unresolvable' WHEN 15 THEN 'missing_valid_time' WHEN 16 THEN 'unknown_source' END AS reason FROM e WHERE k <> 13"""
)
def event_validation(spark, sf_dir):
    """Envelopes that break each published rule in turn; the rejected ones keep their payload."""
    envelopes = _envelopes(spark, sf_dir)
    _, rejected = op.admitted(envelopes, spark.createDataFrame([("s",)], "source_id string"), ["1.0", "1.1"])
    return rejected.select(F.get_json_object("payload", "$.i").cast("long").alias("i"), "reason")


@query(f"WITH {_N} SELECT i FROM n WHERE k = 13")
def events_accepted(spark, sf_dir):
    return op.admitted(_envelopes(spark, sf_dir), spark.createDataFrame([("s",)], "source_id string"), ["1.0", "1.1"])[0].select("i")


def _envelopes(spark, sf_dir):
    i, k = F.col("o_orderkey"), F.col("o_orderkey") % 17
    kind = F.when(k == 4, "retract_node").when(k == 6, "identity_claim").when(k == 7, "record_investigation").when(k == 11, "upsert_edge").when(k.isin(12, 13), "confirm_merge").when(k == 14, "retract_edge").when(k == 2, "nothing").otherwise("upsert_node")
    props = F.when(k == 7, '{"sre.investigation.x": 1, "other": 2}').when(k == 8, '{"kind": "secret", "value": "x"}').when(k == 9, '{"a": {"span_id": "x"}}').when(k == 10, '{"a": [1, 2.5]}').otherwise('{"replicas": 3, "ports": [80]}')
    return table(spark, sf_dir, "orders").select(
        i.alias("i"), F.when(k != 0, i.cast("string")).alias("event_id"), F.when(k == 1, "").when(k == 16, "stranger").otherwise("s").alias("source_id"), F.when(k == 3, "9").otherwise("1.0").alias("schema_version"), kind.alias("type"),
        F.when(k != 4, "ns=v").alias("ref"), F.when(k != 11, "ns=a").alias("src"), F.lit("ns=b").alias("dst"), (k != 5).alias("known_type"), F.when(k != 15, F.col("o_orderdate")).alias("valid_at"), F.lit(False).alias("valid_from_unknown"),
        F.when(k == 6, "deploy.release").otherwise("host").alias("claim_namespace"), props.alias("props"), F.when(k != 12, "someone").alias("principal"), (k != 14).alias("resolvable"),
    )


@query("WITH b AS (SELECT 's' || (event_id % 7) AS source_id, 'kind' || (event_id % 3) AS kind, ts FROM events) SELECT source_id, arg_max(kind, (ts, kind)) AS kind, epoch_us(min(ts)) AS registered_at, epoch_us(max(ts)) AS seen_at FROM b GROUP BY 1")
def source_registration(spark, sf_dir):
    """Registrations in two batches: the first one's time and the last one's kind."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.concat(F.lit("s"), i % 7).alias("source_id"), F.concat(F.lit("kind"), i % 3).alias("kind"), F.col("ts").cast("timestamp").alias("at"), i)
    none = spark.createDataFrame([], "source_id string, kind string, registered_at timestamp, seen_at timestamp")
    first = op.registered(none, rows.where("event_id % 2 = 0"))
    return op.registered(first, rows.where("event_id % 2 = 1")).withColumn("registered_at", m.micros("registered_at")).withColumn("seen_at", m.micros("seen_at"))


@query(f"WITH {m.A} SELECT source, epoch_us(min(observed_from)) AS extent_from, epoch_us(max(observed_from)) AS extent_to, max(event_id) AS last_event, count(*) AS events FROM a WHERE observed_from > TIMESTAMP '{m.T1}' AND observed_from <= TIMESTAMP '{m.T2}' GROUP BY 1")
def checkpoint_write(spark, sf_dir):
    found = op.checkpointed(m.assertions(spark, sf_dir), "source", m.at(m.T2), m.at(m.T1))
    return found.select("source", m.micros("extent_from").alias("extent_from"), m.micros("extent_to").alias("extent_to"), "last_event", "events")


@query(
    f"""WITH {m.A}, l AS (SELECT * FROM a WHERE event_id <= 700), n AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity, source ORDER BY valid_from, event_id) AS nxt FROM l)
    SELECT entity, source, state, epoch_us(valid_from) AS valid_from, epoch_us(nxt) AS valid_to FROM n"""
)
def log_replay(spark, sf_dir):
    """Segments of all entities from a prefix of the log, as the projector of record folds them."""
    a = m.assertions(spark, sf_dir).where("event_id <= 700")
    events = a.select("entity", F.lit("upsert").alias("kind"), "source", "state", m.micros("valid_from").alias("t"), F.lit(0).alias("observed"), F.col("event_id").alias("seq"))
    return op.replayed(events, F.lit(700))
