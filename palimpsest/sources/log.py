"""The append-only event log: validation, idempotent append, duplicates, rejections, pages, checkpoints, extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Property names that carry telemetry or secrets are refused.
FORBIDDEN_PROPS = ("password", "token", "secret", "metric_value")
MAX_PROPS = 4096


def idempotency_key(explicit: Column, alert: Column, event_id: Column) -> Column:
    """The explicit key, else the alert transition's, else the event's own."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(alert, F.lit("")), event_id.cast("string"))


def rejection(event_id: Column, kind: Column, kinds: list[str], valid: Column, observed: Column, props: Column) -> Column:
    """The first rule that an event breaks, as a reason code; null if none."""
    code = F.when(event_id.isNull(), "missing_event_id").when(kind.isNull(), "missing_type").when(~kind.isin(kinds), "unknown_type").when(valid.isNull(), "missing_valid_time")
    code = code.when(observed < valid, "observed_before_valid").when(F.length(props) > MAX_PROPS, "props_too_large")
    for name in FORBIDDEN_PROPS:
        code = code.when(props.contains(f'"{name}"'), "forbidden_property")
    return code


def deliveries(log: DataFrame, key: str, arrival: list[str], payload: Column) -> DataFrame:
    """log with delivery (1 for the one that stands) and payload_differs from that one."""
    order = Window.partitionBy(key).orderBy(*arrival)
    digest = F.sha2(payload, 256)
    out = log.withColumn("delivery", F.row_number().over(order)).withColumn("_digest", digest)
    return out.withColumn("payload_differs", F.col("_digest") != F.first("_digest").over(order)).drop("_digest")


def append(log: DataFrame, batch: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The rows of a batch to append: first delivery of each key that the log hasn't yet."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*arrival))).where("_n = 1").drop("_n")
    return first.join(log.select(key), key, "left_anti")


def page(log: DataFrame, after: int, size: int, seq: str = "event_id") -> DataFrame:
    """Keyset page: `size` rows behind a sequence number."""
    return log.where(F.col(seq) > after).orderBy(seq).limit(size)


def extent(log: DataFrame, observed: str = "observed_from") -> DataFrame:
    return log.agg(F.min(observed).alias("extent_from"), F.max(observed).alias("extent_to"), F.count(F.lit(1)).alias("n"))


def gaps(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints that report a gap, with where it starts: the extent of the source's previous checkpoint that had one.

    checkpoints: source, seq, extent_to (null if unknown), gap.
    """
    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return checkpoints.withColumn("gap_from", F.last("extent_to", ignorenulls=True).over(before)).where("gap")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Export in the order of the log's sequence, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Load exported events; the schema is declared, never inferred."""
    return spark.read.schema(schema).json(path)


#: Property names that carry telemetry at any depth, and the length of a list of numbers that is a series.
TELEMETRY_PROPS, SERIES = ("metric_value", "value", "log_body", "body", "span_id", "trace_id", "samples"), 2
#: Namespaces of keys that several entities share, which no identity may claim.
CORRELATIONS = ("deploy.commit_sha", "deploy.image", "deploy.release")
#: Kinds of events by what they must name.
DATED = ("upsert_node", "upsert_edge", "retract_node", "retract_edge", "observe_change")
ENDS = ("upsert_edge", "retract_edge", "propose_dependency", "confirm_dependency", "reject_dependency")
PAIRS = ("confirm_merge", "reject_merge", "manual_merge", "split_entity")
INVESTIGATIONS = ("record_investigation", "submit_human_fact", "reopen_investigation", "label_investigation")
OTHERS = ("identity_claim", "correlate_entity", "source_checkpoint", "alert_transition")


def refusal(versions: list[str]) -> Column:
    """The first published rule that an envelope breaks, or null; the most structural rules come first.

    Columns read: event_id, source_id, schema_version, type, registered (its source is), ref, src, dst, known_type (node,
    edge or change kind is given), valid_at, valid_from_unknown, claim_namespace, props (JSON), principal, resolvable.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = F.col("type")
    key = lambda names: rf'"({"|".join(names)})"\s*:'
    series = rf"\[\s*-?\d+(\.\d+)?(\s*,\s*-?\d+(\.\d+)?){{{SERIES - 1},}}\s*\]"
    secret = F.col("props").rlike(r'"kind"\s*:\s*"secret"') & F.col("props").rlike(key(("value", "secret_value", "data")))
    telemetry = F.col("props").rlike(key(TELEMETRY_PROPS)) | F.col("props").rlike(series) | (F.octet_length("props") > MAX_PROPS)
    foreign = F.exists(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")), lambda k: ~k.startswith("sre.investigation."))
    code = F.when(none("event_id"), "missing_event_id").when(none("source_id"), "missing_source").when(~F.coalesce(kind, F.lit("")).isin(*DATED, *ENDS, *PAIRS, *INVESTIGATIONS, *OTHERS), "untyped")
    code = code.when(~F.col("schema_version").isin(versions) | F.col("schema_version").isNull(), "unknown_schema_version")
    code = code.when(kind.isin(*ENDS) & (none("src") | none("dst")), "missing_ref").when(kind.isin("upsert_node", "retract_node", "observe_change", "identity_claim", "correlate_entity", *PAIRS) & none("ref"), "missing_ref")
    code = code.when(kind.isin("upsert_node", "upsert_edge", "observe_change", "propose_dependency") & ~F.coalesce("known_type", F.lit(False)), "unknown_type")
    code = code.when(kind.isin(*DATED) & F.col("valid_at").isNull() & ~F.coalesce("valid_from_unknown", F.lit(False)), "missing_valid_time")
    code = code.when((kind == "identity_claim") & F.col("claim_namespace").isin(*CORRELATIONS), "correlation_as_identity")
    code = code.when(kind.isin(*INVESTIGATIONS) & foreign, "prop_namespace").when(kind.isin("upsert_node", "upsert_edge", "observe_change") & secret, "secret_value").when(kind.isin("upsert_node", "upsert_edge", "observe_change") & telemetry, "telemetry_payload")
    code = code.when(~F.coalesce("registered", F.lit(False)), "unknown_source").when(kind.isin("retract_node", "retract_edge") & ~F.coalesce("resolvable", F.lit(False)), "ref_unresolvable")
    return code.when(kind.isin(*PAIRS) & none("principal"), "missing_principal")


def admitted(envelopes: DataFrame, sources: DataFrame, versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) envelopes; rejected ones keep their whole payload as JSON with the reason. sources: source_id."""
    known = envelopes.join(sources.select("source_id").distinct().withColumn("registered", F.lit(True)), "source_id", "left")
    told = known.withColumn("reason", refusal(versions))
    payload = F.to_json(F.struct(*(F.col(f"`{c}`") for c in envelopes.columns)))
    return told.where("reason IS NULL").select(*envelopes.columns), told.where("reason IS NOT NULL").select("event_id", "source_id", "reason", payload.alias("payload"))


def registered(sources: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, kind, registered_at, seen_at: a source keeps its first registration and takes the kind of its last. new: source_id, kind, at."""
    both = sources.select("source_id", "kind", F.col("registered_at").alias("a"), F.col("seen_at").alias("b")).unionByName(new.select("source_id", "kind", F.col("at").alias("a"), F.col("at").alias("b")))
    return both.groupBy("source_id").agg(F.max_by("kind", F.struct("b", "kind")).alias("kind"), F.min("a").alias("registered_at"), F.max("b").alias("seen_at"))


def checkpointed(log: DataFrame, source: str, at: Column, since: Column | None = None) -> DataFrame:
    """One checkpoint row a source: what its events since the last checkpoint cover. log: source, observed_from, event_id."""
    own = log if since is None else log.where(F.col("observed_from") > since)
    return own.where(F.col("observed_from") <= at).groupBy(source).agg(F.min("observed_from").alias("extent_from"), F.max("observed_from").alias("extent_to"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("events")).withColumn("checkpoint_at", at)


def replayed(log: DataFrame, upto: Column, seq: str = "seq") -> DataFrame:
    """Segments of every entity from the log alone, as they were when `upto` was appended: the projector of record over a prefix of it."""
    from palimpsest.operators.projection import project

    return project(log.where(F.col(seq) <= upto))
