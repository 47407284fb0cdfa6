"""Hypothesis ledger: priors, likelihood ratios, posteriors that sum to exactly one million units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Natural logs of the ratios 1.5, 3, 10 and 50, to six decimals.
LN_RATIO = (("weak", 0.405465), ("moderate", 1.098612), ("strong", 2.302585), ("decisive", 3.912023))
#: Upper bounds of the confidence buckets.
BUCKETS = (("very_low", 0.10), ("low", 0.30), ("moderate", 0.60), ("high", 0.85), ("very_high", 1.00))
UNITS = 1_000_000
OPEN = "open"


def ln_ratio(direction: Column, strength: Column) -> Column:
    size = F.lit(None).cast("double")
    for name, value in LN_RATIO:
        size = F.when(strength == name, value).otherwise(size)
    return F.when(direction == "supports", size).when(direction == "refutes", -size).otherwise(0.0)


def bucket(confidence: Column) -> Column:
    out = F.lit(BUCKETS[-1][0])
    for name, high in reversed(BUCKETS[:-1]):
        out = F.when(confidence < high, name).otherwise(out)
    return out


def apportion(shares: DataFrame, group: str, id_: str, share: str) -> DataFrame:
    """shares with `units` that sum to UNITS in every group: floors, and the units left over to the largest remainders, ties by id."""
    scaled = F.greatest(F.col(share), F.lit(0.0)) * UNITS
    floors = shares.withColumn("_f", F.floor(scaled)).withColumn("_r", scaled - F.floor(scaled))
    g = Window.partitionBy(group)
    left = F.lit(UNITS) - F.sum("_f").over(g)
    place = F.row_number().over(g.orderBy(F.desc("_r"), id_))
    out = floors.withColumn("_left", left).withColumn("_n", place)
    return out.withColumn("units", (F.col("_f") + (F.col("_n") <= F.col("_left")).cast("long")).cast("long")).drop("_f", "_r", "_left", "_n")


def priors(scores: DataFrame, group: str, id_: str, unseen: float) -> DataFrame:
    """group, id, prior: scores normalised and scaled by 1 - unseen; the open hypothesis has the rest, all if no score is positive."""
    total = F.sum("score").over(Window.partitionBy(group))
    own = scores.select(group, id_, F.when(total > 0, F.col("score") / total * (1 - unseen)).otherwise(0.0).alias("share"))
    rest = scores.groupBy(group).agg(F.sum("score").alias("s")).select(group, F.lit(OPEN).alias(id_), F.when(F.col("s") > 0, unseen).otherwise(1.0).alias("share"))
    units = apportion(own.unionByName(rest), group, id_, "share")
    return units.select(group, id_, (F.col("units") / UNITS).alias("prior"))


def posteriors(prior: DataFrame, judgments: DataFrame, group: str, id_: str) -> DataFrame:
    """group, id, posterior: ln prior + sum of ln ratios, by log-sum-exp over the group, apportioned. A prior of 0 stays 0."""
    evidence = judgments.groupBy(group, id_).agg(F.sum(ln_ratio(F.col("direction"), F.col("strength"))).alias("ln"))
    weighed = prior.join(evidence, [group, id_], "left").withColumn("w", F.when(F.col("prior") > 0, F.log("prior") + F.coalesce("ln", F.lit(0.0))))
    g = Window.partitionBy(group)
    raised = weighed.withColumn("e", F.when(F.col("w").isNotNull(), F.exp(F.col("w") - F.max("w").over(g))).otherwise(0.0))
    share = raised.withColumn("share", F.round(F.col("e") / F.sum("e").over(g), 9))
    return apportion(share, group, id_, "share").select(group, id_, (F.col("units") / UNITS).alias("posterior"))


def conflicts(judgments: DataFrame) -> DataFrame:
    """Hypotheses that some evidence supports and other refutes, with the sum of their ln ratios: which way all of it leans."""
    both = judgments.groupBy("incident", "hypothesis").agg(
        F.count_if(F.col("direction") == "supports").alias("supports"), F.count_if(F.col("direction") == "refutes").alias("refutes"), F.round(F.sum(ln_ratio(F.col("direction"), F.col("strength"))), 6).alias("net")
    )
    return both.where("supports > 0 AND refutes > 0")


#: Candidates whose confidence is nearer than this aren't told apart; what prior mass alone may be called.
SEPARATION, CEILING = 0.05, "moderate"
#: The first wave's thresholds.
CONCENTRATION, NEW_PATTERNS, ERROR_FLOOR = 2.0, 1, 0.05
#: The share of a budget that is kept back.
RESERVE = 0.15


def non_separable(ranked: DataFrame) -> DataFrame:
    """incident, hypotheses, spread: runs of candidates, by confidence descending, within SEPARATION of the run's first.

    ranked: incident, hypothesis, confidence, status. Refuted and exonerated ones, and those without mass, take no part.
    """
    live = ranked.where(~F.col("status").isin("refuted", "exonerated") & (F.col("confidence") > 0))
    listed = live.groupBy("incident").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("key"), "hypothesis", "confidence"))).alias("h"))
    member = "struct<hypothesis:string,confidence:double>"
    start = F.array().cast(f"array<array<{member}>>")

    def step(runs: Column, x: Column) -> Column:
        own = F.array(F.struct(x["hypothesis"].cast("string").alias("hypothesis"), x["confidence"].alias("confidence")))
        last = F.try_element_at(runs, F.lit(-1))
        near = F.round(last[0]["confidence"] - x["confidence"], 6) <= SEPARATION
        joined = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.concat(last, own)))
        return F.when((F.size(runs) > 0) & near, joined).otherwise(F.concat(runs, F.array(own)))

    runs = listed.select("incident", F.explode(F.aggregate("h", start, step)).alias("r")).where(F.size("r") > 1)
    return runs.select("incident", F.transform("r", lambda x: x["hypothesis"]).alias("hypotheses"), F.round(F.get("r", F.lit(0))["confidence"] - F.element_at("r", -1)["confidence"], 6).alias("spread"))


def reported_bucket(confidence: Column, widened: Column, evidenced: Column) -> Column:
    """The bucket that is published: one step up or down where a test was cut short (widened: up, down or null), and never above CEILING without evidence."""
    names = F.array(*(F.lit(n) for n, _ in BUCKETS))
    place = F.array_position(names, bucket(confidence)).cast("int")
    moved = F.when(widened == "up", F.least(place + 1, F.lit(len(BUCKETS)))).when(widened == "down", F.greatest(place - 1, F.lit(1))).otherwise(place)
    most = [n for n, _ in BUCKETS].index(CEILING) + 1
    return F.element_at(names, F.when(F.coalesce(evidenced, F.lit(False)), moved).otherwise(F.least(moved, F.lit(most))))


def one_judgment(judgments: DataFrame, order: str) -> DataFrame:
    """judgments with `accepted`: the first on an evidence and hypothesis counts, later ones are refused."""
    w = Window.partitionBy("evidence", "hypothesis").orderBy(order)
    return judgments.withColumn("accepted", F.row_number().over(w) == 1)


def first_wave(capability: Column, outcome: Column, separable: Column, rises: Column, rates: Column, n: Column) -> Column:
    """direction and strength that an answer gives its hypothesis, null if it says nothing.

    separable, rises: of a comparison (separable null: it had none); rates: error rates by version; n: new patterns or
    error spans. No data bears weakly against a change that comparisons should have shown.
    """

    def told(direction: str, strength: str | None = None) -> Column:
        return F.struct(F.lit(direction).alias("direction"), F.lit(strength).cast("string").alias("strength"))

    ordered = F.reverse(F.array_sort(rates))
    most, next_ = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    compare = F.when(separable.isNull(), None).when(~separable, told("neutral")).when(rises, told("supports", "moderate")).otherwise(told("refutes", "weak"))
    versions = F.when((F.size(rates) > 1) & (most > 0) & (most >= CONCENTRATION * next_), told("supports", "strong")).when(F.size(rates) > 1, told("refutes", "moderate")).when((F.size(rates) == 1) & (most >= ERROR_FLOOR), told("supports", "moderate"))
    patterns = F.when(n >= NEW_PATTERNS, told("supports", "moderate")).otherwise(told("neutral"))
    spans = F.when(n > 0, told("supports", "moderate")).otherwise(told("neutral"))
    digest = F.when(capability == "compare", compare).when(capability == "errors_by_version", versions).when(capability == "new_log_patterns", patterns).when(capability == "error_spans", spans)
    nothing = F.when(capability.isin("compare", "errors_by_version"), told("refutes", "weak")).otherwise(told("neutral"))
    return F.when(outcome == "DIGEST", digest).when(outcome == "NO_DATA", nothing)


def status_refusal(to: Column, evidenced: Column, knowledge_only: Column, has_reason: Column, has_next: Column, onset_known: Column) -> Column:
    """Why a hypothesis may not move to a status, or null: nothing returns to proposed; supported needs evidence that isn't a
    document's alone; untested a reason and the next query; exonerated an onset estimate that is in the ledger."""
    unsupported = F.when(knowledge_only, "only_a_document").when(~evidenced, "unsupported_status")
    out = F.when(to == "proposed", "never_returns_to_proposed").when(to == "supported", unsupported)
    out = out.when((to == "untested") & ~(has_reason & has_next), "untested_without_next_query").when((to == "exonerated") & ~onset_known, "no_onset_estimate")
    return out.when(~to.isin("proposed", "supported", "untested", "exonerated", "refuted", "inconclusive"), "unknown_status")


def candidate_effects(changes: DataFrame, onset: DataFrame, group: str) -> DataFrame:
    """Changes (group, change, start: seconds) that began after the group's onset (at, uncertainty: seconds) by more than it is uncertain: effects, not causes."""
    return changes.join(onset, group).where(F.col("start") - F.col("at") > F.col("uncertainty")).select(group, "change")


def earliest_onset(estimates: DataFrame, group: str) -> DataFrame:
    """Of each group's confident estimates (at, uncertainty, confident) the earliest, then the surest."""
    return estimates.where("confident").groupBy(group).agg(F.min(F.struct("at", "uncertainty")).alias("e")).select(group, "e.at", "e.uncertainty")


def verdicts(hypotheses: DataFrame) -> DataFrame:
    """incident, verdict, hypothesis: named for the best supported candidate with evidence, unobserved if only the open one is supported, else unknown.

    hypotheses: incident, hypothesis, confidence, status, evidenced; the open one is named OPEN.
    """
    open_ = F.col("hypothesis") == OPEN
    named = F.min(F.when(~open_ & (F.col("status") == "supported") & F.col("evidenced"), F.struct((-F.col("confidence")).alias("key"), "hypothesis")))
    own = hypotheses.groupBy("incident").agg(named.alias("n"), F.max(open_ & (F.col("status") == "supported")).alias("o"), F.max(open_).alias("has"))
    verdict = F.when(F.col("n").isNotNull(), "named").when(F.col("o"), "unobserved").otherwise("unknown")
    return own.select("incident", verdict.alias("verdict"), F.coalesce("n.hypothesis", F.when(F.col("has"), OPEN)).alias("hypothesis"))


def moved(posteriors: DataFrame, group: str, order: str, id_: str) -> DataFrame:
    """group, order, l1: how far each call moved the posterior from the one before, summed over hypotheses; the first call moved nothing."""
    before = F.coalesce(F.lag("posterior").over(Window.partitionBy(group, id_).orderBy(order)), F.col("posterior"))
    return posteriors.withColumn("_d", F.abs(F.col("posterior") - before)).groupBy(group, order).agg(F.round(F.sum("_d"), 6).alias("l1"))


def admitted(calls: DataFrame, group: str, order: str, cap: float, reserve: float = RESERVE) -> DataFrame:
    """group, order, admitted, spent: calls in order, each admitted if what was spent and its cost stay within the cap.

    Calls that aren't `final` also leave the reserve untouched. A refused call spends nothing. calls: cost, final.
    """
    listed = calls.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("cost").cast("double").alias("cost"), "final"))).alias("c"))
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<struct<o:bigint,ok:boolean,spent:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        total = F.round(s["spent"] + x["cost"], 6)
        ok = total <= F.when(x["final"], F.lit(float(cap))).otherwise(F.lit(round(cap * (1 - reserve), 6)))
        spent = F.when(ok, total).otherwise(s["spent"])
        return F.struct(spent.alias("spent"), F.concat(s["out"], F.array(F.struct(x["o"].cast("long").alias("o"), ok.alias("ok"), spent.alias("spent")))).alias("out"))

    told = listed.select(group, F.explode(F.aggregate("c", start, step, lambda s: s["out"])).alias("r"))
    return told.select(group, F.col("r.o").alias(order), F.col("r.ok").alias("admitted"), "r.spent")


def gap_overlap(windows: DataFrame, gaps: DataFrame, seconds: int = 3600) -> DataFrame:
    """windows with `in_gap`: some gap (source, gap_from, gap_to) of their source overlaps them; null ends are open.

    A gap does if the latest end of those that begin before a window's end is after its start. So windows, by their
    ends, and gaps, by their starts, are dealt to buckets of `seconds`: a running maximum inside a bucket and one over the
    buckets before it, a row each, tell it, and no window meets a gap.
    """
    open_ = F.lit((1 << 63) - 1)
    end = lambda c: F.coalesce(F.unix_micros(c), open_)
    own = windows.select("source", end("valid_to").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_end"), F.struct(*windows.columns).alias("_w"))
    dealt = gaps.where("gap_from IS NOT NULL AND source IS NOT NULL").select("source", F.unix_micros("gap_from").alias("_t"), F.lit(1).alias("_side"), end("gap_to").alias("_end"), F.lit(None).cast(own.schema["_w"].dataType).alias("_w"))
    rows = own.unionByName(dealt).withColumn("_b", F.floor(F.col("_t") / (seconds * 1_000_000)))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "_b").agg(F.max("_end").alias("_end")).select("source", "_b", F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("source", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)  # a gap that begins at a window's end comes after it
    told = rows.withColumn("_in", F.max("_end").over(inside)).where("_side = 0").join(buckets, ["source", "_b"], "left")
    return told.select("_w.*", F.coalesce(F.greatest("_in", "_before") > F.unix_micros("_w.valid_from"), F.lit(False)).alias("in_gap"))


def neighbouring_incidents(alerts: DataFrame, edges: DataFrame, minutes: int = 10) -> DataFrame:
    """alert, incident: alerts of one entity, or of two that an edge joins, within `minutes` of each other are one incident, named by its smallest alert.

    alerts: alert, entity, at; edges: src, dst. Alerts are dealt to time buckets of that width and meet those of their
    own and the next bucket, by equality of (entity, bucket).
    """
    from palimpsest.operators.components import components

    width = minutes * 60
    own = alerts.select("alert", "entity", F.unix_micros("at").alias("t"), F.floor(F.unix_seconds("at") / width).alias("b"))
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reach = own.select("alert", "t", "b", F.col("entity").alias("to")).unionByName(own.join(near, F.col("entity") == F.col("src")).select("alert", "t", "b", F.col("dst").alias("to"))).distinct()
    dealt = reach.select(F.col("alert").alias("a"), F.col("t").alias("ta"), "to", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    met = dealt.join(own.select(F.col("alert").alias("c"), F.col("t").alias("tc"), F.col("entity").alias("to"), "b"), ["to", "b"])
    pairs = met.where((F.col("a") != F.col("c")) & (F.abs(F.col("ta") - F.col("tc")) <= width * 1_000_000)).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    joined = components(pairs)
    return alerts.select("alert").join(joined.withColumnRenamed("entity", "alert"), "alert", "left").select("alert", F.coalesce("component", "alert").alias("incident"))


def settled(moves: DataFrame, group: str, order: str, least: float = 0.02, calls: int = 5) -> DataFrame:
    """Calls after which the last `calls` moved the posterior by less than `least` in all."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-(calls - 1), 0)
    return moves.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("moved", F.round(F.sum("l1").over(w), 6)).where((F.col("_n") == calls) & (F.col("moved") < least)).drop("_n")


def grouped_incidents(alerts: DataFrame, minutes: int = 10) -> DataFrame:
    """alerts with the first one of their incident: an alert belongs to the incident of its entity's last alert if that is recent."""
    w = Window.partitionBy("entity").orderBy("start", "change_id")
    gap = F.unix_micros("start") - F.unix_micros(F.lag("start").over(w))
    new = (gap.isNull() | (gap > minutes * 60_000_000)).cast("int")
    runs = alerts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("incident", F.first("change_id").over(Window.partitionBy("entity", "_run").orderBy("start", "change_id"))).drop("_new", "_run")
