"""Write side of edges, changes, alerts and identity: from typed events to rows, a batch a type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Statuses of a proposal, and how many rows a loop of resolution may take.
PENDING, CONFIRMED, REJECTED, CONFLICT = "pending", "confirmed", "rejected", "conflict"


def resolved_edges(events: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, placeholders) of edge events (event_id, src, dst: refs, type, ...) against claims (ref, entity).

    A ref that nothing claims gets a placeholder entity, named by its digest, that the first event to name it makes;
    an edge from an entity to itself is dropped.
    """
    entity = claims.groupBy("ref").agg(F.min("entity").alias("entity"))
    minted = lambda ref: F.concat(F.lit("placeholder-"), F.substring(F.sha2(ref, 256), 1, 16))
    both = events.join(entity.withColumnsRenamed({"ref": "src", "entity": "_s"}), "src", "left").join(entity.withColumnsRenamed({"ref": "dst", "entity": "_d"}), "dst", "left")
    rows = both.withColumn("src_entity", F.coalesce("_s", minted(F.col("src")))).withColumn("dst_entity", F.coalesce("_d", minted(F.col("dst"))))
    ends = rows.select("event_id", F.explode(F.array(F.struct(F.col("src").alias("ref"), F.col("src_entity").alias("entity"), F.col("_s").isNull().alias("new")), F.struct(F.col("dst").alias("ref"), F.col("dst_entity").alias("entity"), F.col("_d").isNull().alias("new")))).alias("e"))
    placeholders = ends.where("e.new").groupBy("e.ref", "e.entity").agg(F.min("event_id").alias("created_by"))
    return rows.where(F.col("src_entity") != F.col("dst_entity")).drop("_s", "_d"), placeholders


def retract_edges(edges: DataFrame, retractions: DataFrame) -> DataFrame:
    """edges with valid_to and closed_by set by the first retraction of their (src, dst, type) that falls inside them."""
    key = ["src", "dst", "type"]
    hits = edges.join(retractions.select(*key, F.col("valid_end").alias("_end"), F.col("event_id").alias("_by")), key)
    inside = hits.where((F.col("valid_from") < F.col("_end")) & (F.col("valid_to").isNull() | (F.col("_end") < F.col("valid_to"))))
    first = inside.groupBy("edge_id").agg(F.min(F.struct("_end", "_by")).alias("_r"))
    return edges.join(first, "edge_id", "left").withColumn("valid_to", F.coalesce("_r._end", "valid_to")).withColumn("closed_by", F.col("_r._by")).drop("_r")


def observed_changes(events: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, targets) of change events (event_id, ref, valid_at, valid_end, source_observed, observed, targets: refs).

    A change lasts from valid_at, or from when its source learned of it, or else from its arrival (from_unknown then),
    to its end or for one microsecond. targets: event_id, ref, entity; a target without an entity waits.
    """
    start = F.coalesce("valid_at", "source_observed", "observed")
    micro = F.expr("INTERVAL 1 MICROSECOND")
    rows = events.select("event_id", "ref", start.alias("valid_from"), F.coalesce("valid_end", start + micro).alias("valid_to"), F.col("valid_at").isNull().alias("from_unknown"))
    named = events.select("event_id", F.explode(F.array_distinct("targets")).alias("ref"))
    return rows, named.join(claims.groupBy("ref").agg(F.min("entity").alias("entity")), "ref", "left")


def attached(targets: DataFrame, claims: DataFrame) -> DataFrame:
    """event_id, ref, entity, attached_by of the waiting targets that a later claim (ref, entity, event_id) names: the first one."""
    first = claims.groupBy("ref").agg(F.min(F.struct("event_id", "entity")).alias("c"))
    return targets.where("entity IS NULL").drop("entity").join(first, "ref").select("event_id", "ref", "c.entity", F.col("c.event_id").alias("attached_by"))


def alert_lanes(transitions: DataFrame) -> DataFrame:
    """monitor, group_key, state, valid_from, valid_to: each group of a monitor is a lane of its own, and a state holds to the next transition; repeats of a state are one."""
    w = Window.partitionBy("monitor", "group_key").orderBy("at", "event_id")
    new = transitions.withColumn("_old", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("_old")))
    return new.select("monitor", "group_key", "state", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"))


def claim_store(claims: DataFrame) -> DataFrame:
    """One row a (namespace, value, source): entity of the latest claim, and the latest attributes that aren't empty."""
    order = F.struct("observed", "event_id")
    full = F.when(F.size("attributes") > 0, order)
    return claims.groupBy("namespace", "value", "source").agg(F.max_by("entity", order).alias("entity"), F.max_by("attributes", full).alias("attributes"))


def redirects(decisions: DataFrame) -> DataFrame:
    """id, merged_into of the merges in force: of each pair (surviving, merged) the last decision counts; only merges redirect.

    decisions: seq, kind (auto_merge, confirm, manual_merge, reject or split), surviving, merged, human. A human decision
    outranks an automatic one whatever its time.
    """
    last = decisions.groupBy("surviving", "merged").agg(F.max_by("kind", F.struct("human", "seq")).alias("kind"))
    merges = last.where(F.col("kind").isin("auto_merge", "confirm", "manual_merge"))
    return merges.groupBy(F.col("merged").alias("id")).agg(F.min("surviving").alias("merged_into"))


def absorbed(assertions: DataFrame, canonical: DataFrame) -> DataFrame:
    """assertions re-keyed to the entity that survives, with the one they were made of as `stated_of`; refold them after."""
    to = canonical.select(F.col("id").alias("entity"), F.col("canonical").alias("_to"))
    return assertions.join(to, "entity", "left").withColumn("stated_of", F.col("entity")).withColumn("entity", F.coalesce("_to", "entity")).drop("_to")


def absorbed_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """edges between surviving entities; what would join an entity with itself goes."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(canonical.select(F.col("id").alias(end), F.col("canonical").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.where(F.col("src") != F.col("dst"))


def split_off(claims: DataFrame, detached: DataFrame) -> DataFrame:
    """claims with the detached ones (claim_id, to) moved to another entity; the rest stay."""
    return claims.join(detached, "claim_id", "left").withColumn("entity", F.coalesce("to", "entity")).drop("to")


def filed_suggestions(found: DataFrame, decided: DataFrame, canonical: DataFrame) -> DataFrame:
    """pair, rule, score, status of probable pairs (a, b, rule, score) between surviving entities.

    A pair that is one entity by now is left out. Status: rejected pairs become conflicts, as a rule still finds what a
    person refused; confirmed ones stay confirmed; all others are pending. decided: pair, kind.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    rows = found
    for end in ("a", "b"):
        rows = rows.join(canonical.select(F.col("id").alias(end), F.col("canonical").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    own = rows.where("a <> b").select(F.concat_ws("|", lo, hi).alias("pair"), "rule", "score")
    best = own.groupBy("pair").agg(F.max(F.struct("score", "rule")).alias("s")).select("pair", "s.rule", "s.score")
    status = F.when(F.col("kind") == "reject", CONFLICT).when(F.col("kind") == "confirm", CONFIRMED).otherwise(PENDING)
    return best.join(decided, "pair", "left").select("pair", "rule", "score", status.alias("status"))


def dependency_proposals(events: DataFrame) -> DataFrame:
    """proposal, status, rule, score, n_events of directed dependencies, by an ordered fold of their events.

    events: src, dst, type, seq, kind (propose, confirm or reject), rule, score. A decision without a proposal is
    refused and counts for nothing; a proposal after a rejection makes a conflict, after a confirmation nothing.
    """
    key = F.concat_ws("|", "src", "dst", "type")
    listed = events.groupBy(key.alias("proposal")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "rule", "score"))).alias("e"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        propose = x["kind"] == "propose"
        moved = F.when(propose & s["status"].isNull(), PENDING).when(propose & (s["status"] == REJECTED), CONFLICT).when(propose, s["status"])
        moved = moved.when(s["status"].isNull(), None).when(x["kind"] == "confirm", CONFIRMED).otherwise(REJECTED)
        told = propose & (s["status"].isNull() | (s["status"] == PENDING))
        return F.struct(moved.cast("string").alias("status"), F.when(told, x["rule"]).otherwise(s["rule"]).alias("rule"), F.when(told, x["score"]).otherwise(s["score"]).alias("score"), (s["n"] + F.when(moved.isNotNull(), 1).otherwise(0)).alias("n"))

    folded = listed.select("proposal", F.aggregate("e", start, step).alias("s"))
    return folded.where("s.status IS NOT NULL").select("proposal", "s.status", "s.rule", "s.score", F.col("s.n").alias("n_events"))


def restated(segments: DataFrame, restatements: DataFrame) -> DataFrame:
    """Segments (segment, source, valid_from, valid_to, event_id) cut again at the instants inside them at which their source restated them.

    Each piece has the last assertion at or before its start; restatements on or outside a segment's bounds cut nothing.
    restatements: segment, at, event_id.
    """
    inside = restatements.withColumnsRenamed({"event_id": "_by"}).join(segments.select("segment", "valid_from", "valid_to"), "segment")
    cuts = inside.where((F.col("at") > F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
    cuts = cuts.groupBy("segment", "at").agg(F.max("_by").alias("event_id"))
    starts = segments.select("segment", F.col("valid_from").alias("at"), "event_id").unionByName(cuts)
    ends = starts.withColumn("_next", F.lead("at").over(Window.partitionBy("segment").orderBy("at")))
    whole = segments.select("segment", "source", F.col("valid_to").alias("_to"))
    return ends.join(whole, "segment").select("segment", "source", F.col("at").alias("valid_from"), F.coalesce("_next", "_to").alias("valid_to"), "event_id")


def until_settled(step: Callable[[DataFrame], DataFrame], start: DataFrame, rounds: int = 64) -> DataFrame:
    """What a step that may find new rows from those found gives in the end: rounds go on until none is new, 64 at most."""
    from palimpsest.storage import cut

    every = fresh = cut(start.distinct(), "settled")
    for _ in range(rounds):
        fresh = cut(step(every).distinct().join(every, every.columns, "left_anti"), "settled")
        if fresh.isEmpty():
            return every
        every = cut(every.unionByName(fresh), "settled")
    raise RuntimeError(f"still new rows after {rounds} rounds")


def dispatched(events: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "type") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each handler's rows for the events of its kind, and the events that none takes."""
    return {name: f(events.where(F.col(kind) == name)) for name, f in handlers.items()}, events.where(F.col(kind).isNull() | ~F.col(kind).isin(*handlers))
