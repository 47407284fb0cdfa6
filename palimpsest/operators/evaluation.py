"""Evaluation: retrieval and ranking metrics, calibration, coverage, miss rates, claim checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """query, reciprocal_rank, recall_at_k from (query, doc, rank) and (query, doc)."""
    hits = relevant.join(ranked, ["query", "doc"], "left")
    best = hits.groupBy("query").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= k).alias("found"), F.count(F.lit(1)).alias("all"))
    return best.select("query", F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.col("found") / F.col("all"), 6).alias("recall_at_k"))


def reliability(rows: DataFrame, probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """bin, n, forecast, observed, brier: equal bins, the last one closed."""
    at = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    own = rows.select(at.alias("bin"), probability.alias("p"), outcome.cast("double").alias("y"))
    return own.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("forecast"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"))


def scores(rows: DataFrame, probability: Column, outcome: Column) -> DataFrame:
    """brier and log_loss over all rows; probabilities are kept off 0 and 1 by 1e-6."""
    p, y = F.greatest(F.least(probability, F.lit(1 - 1e-6)), F.lit(1e-6)), outcome.cast("double")
    return rows.agg(F.round(F.avg((probability - y) ** 2), 6).alias("brier"), F.round(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"))


def miss_rate(calls: DataFrame, group: str, missed: Column) -> DataFrame:
    return calls.groupBy(group).agg(F.count(F.lit(1)).alias("calls"), F.count_if(missed).alias("misses")).withColumn("rate", F.round(F.col("misses") / F.col("calls"), 6))


def ceiling(incidents: DataFrame, feeder: str, observed: Column, classifiable: Column) -> DataFrame:
    """feeder, ceiling (observed of the classifiable), prior of a cause that no feeder sees."""
    own = incidents.where(classifiable).groupBy(feeder).agg(F.round(F.count_if(observed) / F.count(F.lit(1)), 6).alias("ceiling"))
    return own.withColumn("prior", F.round(1 - F.col("ceiling"), 6))


def passes(trials: DataFrame, task: str, ok: Column) -> DataFrame:
    """task, pass_at_1 (share of trials that pass), pass_all (1 if every one passed, else 0)."""
    won = ok.cast("double")
    return trials.groupBy(task).agg(F.round(F.avg(won), 6).alias("pass_at_1"), F.min(won).alias("pass_all"))


def lift(rates: DataFrame, with_: str, without: str) -> DataFrame:
    """The columns of rates with `lift`, how much the rate `with_` is above `without`, and `harm`: it is below."""
    change = F.round(F.col(with_) - F.col(without), 6)
    return rates.withColumn("lift", change).withColumn("harm", change < 0)


def credit(truth: Column, truth_via: Column, got: Column, got_via: Column) -> Column:
    """localisation (the symptom, last of the path, is right), attribution (the cause, first, is right) and mechanism (share
    of the true steps in their order); 0 for an empty path."""

    def same(at: int) -> Column:
        both = (F.size(truth) > 0) & (F.size(got) > 0)
        return F.when(both & (F.try_element_at(truth, F.lit(at)) == F.try_element_at(got, F.lit(at))), 1.0).otherwise(0.0)

    return F.struct(same(-1).alias("localisation"), same(1).alias("attribution"), ordered_overlap(truth_via, got_via).alias("mechanism"))


def edge_f1(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall, f1 of two sets of edges."""
    both = found.select(*keys).distinct().withColumn("_f", F.lit(1)).join(wanted.select(*keys).distinct().withColumn("_w", F.lit(1)), keys, "full_outer")
    n = both.agg(F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull()).alias("b"), F.count("_f").alias("f"), F.count("_w").alias("w"))
    p, r = F.col("b") / F.col("f"), F.col("b") / F.col("w")
    return n.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("b") / (F.col("f") + F.col("w")), 6).alias("f1"))


def ordered_overlap(want: Column, got: Column) -> Column:
    """Share of a wanted list that another has in its order; 0 if nothing is wanted."""
    return F.when(F.size(want) > 0, F.round(common_subsequence(want, got) / F.size(want), 6)).otherwise(0.0)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two lists, by one row of the table folded over a."""
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.lit(0))

    def line(row: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            up, left, corner = F.get(row, j), F.element_at(done, -1), F.get(row, j - 1)
            return F.concat(done, F.array(F.when(F.get(b, j - 1) == x, corner + 1).otherwise(F.greatest(up, left))))

        return F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)).otherwise(row)

    return F.element_at(F.aggregate(a, start, line), -1)


#: Normal quantiles of a one-sided test at 0.05 with power 0.8.
Z_ALPHA, Z_BETA = 1.6448536269514722, 0.8416212335729143


def required_trials(baseline: float, rate: float) -> float:
    """Trials that tell a true rate from a fixed baseline, one-sided, by the normal approximation; infinite for equal rates."""
    if baseline == rate:
        return math.inf
    return ((Z_ALPHA * math.sqrt(baseline * (1 - baseline)) + Z_BETA * math.sqrt(rate * (1 - rate))) / (baseline - rate)) ** 2


def detectable(baseline: float, trials: int, direction: str = "min") -> float:
    """The rate nearest to the baseline that `trials` tell from it: below it for a gate of direction min, above it for max.

    By 60 bisections; nan if not even the farthest rate is told, or for a baseline that is no rate.
    """
    if trials <= 0 or not 0 <= baseline <= 1:
        return math.nan
    near, far = baseline, 1.0 if direction == "max" else 0.0
    if required_trials(baseline, far) > trials:
        return math.nan
    for _ in range(60):
        middle = (near + far) / 2
        near, far = (near, middle) if required_trials(baseline, middle) <= trials else (middle, far)
    return round(far, 6)


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim, verdict from (claim, text, cites array) and (evidence, digest): removed without cited evidence, demoted if a
    number in the text is in no cited digest, else supported."""
    cited = claims.select("claim", F.explode("cites").alias("evidence")).join(evidence, "evidence")
    number = F.lit(r"\d+(?:\.\d+)?")
    known = cited.groupBy("claim").agg(F.flatten(F.collect_list(F.regexp_extract_all("digest", number, F.lit(0)))).alias("known"))
    out = claims.join(known, "claim", "left").withColumn("said", F.regexp_extract_all("text", number, F.lit(0)))
    return out.select("claim", F.when(F.col("known").isNull(), "removed").when(F.size(F.array_except("said", "known")) > 0, "demoted").otherwise("supported").alias("verdict"))


#: The names of confidence buckets and their upper bounds, for calibration by name.
NAMED = (("very_low", 0.10), ("low", 0.30), ("moderate", 0.60), ("high", 0.85), ("very_high", 1.01))


def named_calibration(rows: DataFrame, probability: Column, outcome: Column) -> DataFrame:
    """bucket, n, forecast, observed, gap by the named buckets, and how far forecast and outcome are apart in each."""
    name = F.lit(None).cast("string")
    for label, high in reversed(NAMED):
        name = F.when(probability < high, label).otherwise(name)
    own = rows.select(name.alias("bucket"), probability.alias("p"), outcome.cast("double").alias("y"))
    out = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("forecast"), F.round(F.avg("y"), 6).alias("observed"))
    return out.withColumn("gap", F.round(F.abs(F.col("forecast") - F.col("observed")), 6))


def calibration_error(rows: DataFrame, probability: Column, outcome: Column) -> DataFrame:
    """error: the gaps of named_calibration() weighed by their numbers."""
    own = named_calibration(rows, probability, outcome)
    return own.agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 6).alias("error"))


def resolution_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """rule, n, right, precision, brier of the pairs (pair, rule, score) that rules found, against the true ones (pair)."""
    own = found.join(truth.select("pair").distinct().withColumn("_t", F.lit(1.0)), "pair", "left").withColumn("y", F.coalesce("_t", F.lit(0.0)))
    out = own.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("right"), F.round(F.avg((F.col("score") - F.col("y")) ** 2), 6).alias("brier"))
    return out.withColumn("precision", F.round(F.col("right") / F.col("n"), 6))


def citation_validity(verdicts: DataFrame, group: str) -> DataFrame:
    """group, claims, valid: the share of claims whose citation holds (verdict supported)."""
    return verdicts.groupBy(group).agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg((F.col("verdict") == "supported").cast("double")), 6).alias("valid"))


def agreement(labels: DataFrame) -> DataFrame:
    """labelled, agreed, rate: of the investigations that people labelled how many they agreed with; the last label of each counts."""
    last = labels.groupBy("investigation").agg(F.max_by("agrees", "seq").alias("agrees"))
    return last.agg(F.count("agrees").alias("labelled"), F.count_if("agrees").alias("agreed")).withColumn("rate", F.round(F.try_divide(F.col("agreed"), F.col("labelled")), 6))


def expectations(candidates: DataFrame, table: DataFrame, answered: DataFrame) -> DataFrame:
    """candidate, missing: for each candidate (candidate, category) the families that its category expects (category, family, decisive) and that nothing answered (candidate, family); decisive ones alone."""
    wanted = candidates.join(table.where("decisive"), "category").select("candidate", "family")
    left = wanted.join(answered.select("candidate", "family").distinct(), ["candidate", "family"], "left_anti")
    return left.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("missing"))


def search_space(entities: DataFrame, edges: DataFrame, gaps: DataFrame, most_entities: int = 40, most_edges: int = 80) -> DataFrame:
    """incident, entities, edges, blind, fits: how large an investigation's graph is, and how many of its sources have a gap in it; it fits within the published bounds."""
    n = entities.groupBy("incident").agg(F.countDistinct("entity").alias("entities"))
    e = edges.groupBy("incident").agg(F.countDistinct("edge").alias("edges"))
    b = entities.join(gaps.select("source").distinct(), "source").groupBy("incident").agg(F.countDistinct("source").alias("blind"))
    out = n.join(e, "incident", "left").join(b, "incident", "left").na.fill(0, ["edges", "blind"])
    return out.withColumn("fits", (F.col("entities") <= most_entities) & (F.col("edges") <= most_edges))


def audit_movement(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """key, before, after, movement (improved, worse, same, new or gone) of a metric between two audits; nearer than 1e-9 is the same."""
    both = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key, "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.abs(F.col("after") - F.col("before")) < 1e-9, "same").when(F.col("after") > F.col("before"), "improved").otherwise("worse")
    return both.withColumn("movement", change)


def uncovered(categories: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Categories that no fixture has."""
    return categories.select("category").distinct().join(fixtures.select("category"), "category", "left_anti")


def report_rows(measures: DataFrame, fixture: str, metrics: list[str]) -> DataFrame:
    """scope, name, metric, value, n: every metric's mean by fixture, and over the corpus with each fixture weighing alike."""
    long = measures.select(fixture, F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in metrics))).alias("m")).select(fixture, "m.*").where("value IS NOT NULL")
    per = long.groupBy(F.col(fixture).cast("string").alias("name"), "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n")).select(F.lit("corpus").alias("scope"), F.lit("").alias("name"), "metric", "value", "n")
    return per.select(F.lit("fixture").alias("scope"), "name", "metric", F.round("value", 6).alias("value"), "n").unionByName(whole)


def deploy_gaps(listed: DataFrame, found: DataFrame, excluded: DataFrame, id_: str) -> DataFrame:
    """listed, excluded, matched, missing, extra, ratio of deploys: those a platform lists but a rule excludes count for neither side."""
    a = listed.select(id_).distinct().withColumn("_l", F.lit(True))
    b = found.select(id_).distinct().withColumn("_f", F.lit(True))
    x = excluded.select(id_).distinct().withColumn("_x", F.lit(True))
    both = a.join(b, id_, "full_outer").join(x, id_, "left")
    counted = both.agg(
        F.count_if(F.col("_l") & F.col("_x").isNull()).alias("listed"), F.count_if(F.col("_l") & F.col("_x").isNotNull()).alias("excluded"), F.count_if(F.col("_l") & F.col("_f") & F.col("_x").isNull()).alias("matched"),
        F.count_if(F.col("_l") & F.col("_f").isNull() & F.col("_x").isNull()).alias("missing"), F.count_if(F.col("_l").isNull() & F.col("_x").isNull()).alias("extra"),
    )
    return counted.withColumn("ratio", F.round(F.try_divide(F.col("matched"), F.col("listed")), 6))
