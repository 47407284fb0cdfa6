"""Write side: from assertions and retractions to state. The closed form is one window; the fold is the projector of record
where retractions may arrive out of order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def state_at(assertions: DataFrame, retractions: DataFrame | None, valid: Column, observed: Column) -> DataFrame:
    """entity, source, state: of each source the latest assertion (asserted, then appended) at or before an instant, as
    known at another, unless a later retraction of the entity cuts it. Right for upserts in any order, and for
    retractions in valid-time order."""
    known = assertions.where((F.col("valid_from") <= valid) & (F.col("observed_from") <= observed))
    best = known.groupBy("entity", "source").agg(F.max_by(F.struct("valid_from", "state"), F.struct("valid_from", "event_id")).alias("b")).select("entity", "source", "b.*")
    if retractions is not None:
        cut = retractions.where((F.col("valid_end") <= valid) & (F.col("observed_from") <= observed)).groupBy("entity").agg(F.max("valid_end").alias("_cut"))
        best = best.join(cut, "entity", "left").where(F.col("_cut").isNull() | (F.col("valid_from") >= F.col("_cut"))).drop("_cut")
    return best.select("entity", "source", "state")


SEGMENTS = "entity string, source string, state string, valid_from long, valid_to long"


def fold(events: pd.DataFrame) -> pd.DataFrame:
    """Segments (source, state, valid_from, valid_to) of one entity, from its events in arrival order.

    events: kind (upsert or retract), source, state, t. An upsert holds from t to the source's next segment, or for as
    long as no retraction has cut what was there; a retraction ends, at t, whatever covers t, of every source.
    """
    lanes: dict[str, list[list]] = {}
    for kind, source, state, t in events[["kind", "source", "state", "t"]].itertuples(index=False):
        if kind == "retract":
            for lane in lanes.values():
                kept = []
                for own in lane:
                    if own[0] < t and (own[1] is None or own[1] > t):
                        own[1] = t
                        kept.append(own)
                    elif own[1] is not None and own[1] <= t or own[3] >= t:
                        kept.append(own)
                lane[:] = kept
            continue
        lane = lanes.setdefault(source, [])
        end = None
        for own in lane:
            if own[0] <= t and (own[1] is None or own[1] > t):
                end, own[1] = own[1], t
            elif own[0] > t and (end is None or own[0] < end):
                end = own[0]
        lane[:] = sorted([own for own in lane if own[1] is None or own[0] < own[1]] + [[t, end, state, t]], key=lambda x: x[0])
    rows = [(events["entity"].iloc[0], source, own[2], own[0], own[1]) for source, lane in sorted(lanes.items()) for own in lane]
    return pd.DataFrame(rows, columns=["entity", "source", "state", "valid_from", "valid_to"]).astype({"valid_from": "Int64", "valid_to": "Int64"})


def project(events: DataFrame) -> DataFrame:
    """Segments of every entity: one ordered fold each, by (observed, seq). An entity's history is one group."""
    ordered = events.select("entity", "kind", "source", "state", "t", "observed", "seq")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fold(rows.sort_values(["observed", "seq"]))

    return ordered.groupBy("entity").applyInPandas(run, SEGMENTS)


def primary(versions: DataFrame) -> DataFrame:
    """Of each entity the record that speaks for it: latest asserted, then source, then event."""
    return versions.groupBy("entity").agg(F.max_by(F.struct("event_id", "state"), F.struct("valid_from", "source", "event_id")).alias("p")).select("entity", "p.event_id", "p.state")


def close_observed(stored: DataFrame, new: DataFrame, key: list[str], content: list[str], now: Column) -> DataFrame:
    """stored and new states of a version table reconciled: rows that are gone or changed close at `now`, new or changed ones open, equal ones stay."""
    a = stored.select(*key, F.struct(*content).alias("_a"), F.col("observed_from").alias("_from"))
    b = new.select(*key, F.struct(*content).alias("_b"))
    both = a.join(b, key, "full_outer").withColumn("_same", F.col("_a").eqNullSafe(F.col("_b")))
    closed = F.struct(F.col("_a").alias("c"), F.col("_from").alias("f"), F.when(~F.col("_same"), now).alias("t"))
    opened = F.struct(F.col("_b").alias("c"), now.alias("f"), F.lit(None).cast("timestamp").alias("t"))
    rows = F.array_compact(F.array(F.when(F.col("_a").isNotNull(), closed), F.when(~F.col("_same") & F.col("_b").isNotNull(), opened)))
    return both.select(*key, F.explode(rows).alias("r")).select(*key, "r.c.*", F.col("r.f").alias("observed_from"), F.col("r.t").alias("observed_to"))


def cascade(edges: DataFrame, retractions: DataFrame) -> DataFrame:
    """Edges ended by the first retraction of an endpoint while they hold, with the retracting event."""
    ends = retractions.select(F.col("entity"), F.col("valid_end"), F.col("event_id").alias("closed_by"))
    touch = edges.select("edge_id", "valid_from", "valid_to", F.explode(F.array("src", "dst")).alias("entity")).join(ends, "entity")
    live = touch.where((F.col("valid_from") < F.col("valid_end")) & (F.col("valid_to").isNull() | (F.col("valid_end") < F.col("valid_to"))))
    first = live.groupBy("edge_id").agg(F.min(F.struct("valid_end", "closed_by")).alias("m"))
    return first.select("edge_id", F.col("m.valid_end").alias("valid_to"), F.col("m.closed_by").alias("closed_as_consequence_of"))


def fold_changes(changes: DataFrame) -> DataFrame:
    """One row a change reference: of each source the latest record; the primary one has the earliest known start, and
    gives every field that it has; others fill the rest in that order."""
    latest = Window.partitionBy("ref", "source").orderBy(F.desc("observed_from"), F.desc("event_id"))
    own = changes.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    order = Window.partitionBy("ref").orderBy(F.col("start").isNull(), "start", "source", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = own.select("ref", *(F.first(c, ignorenulls=True).over(order).alias(c) for c in ("start", "actor", "kind")), F.collect_set("event_id").over(Window.partitionBy("ref")).alias("e"))
    return filled.withColumn("produced_by", F.array_sort("e")).drop("e").distinct()


def provenance(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("event_id")).alias("produced_by"))
