"""Telemetry terms over point, log and state tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARABLE, DIRECTION = 0.20, 0.10


def nearest_rank(values: Column, q: float) -> Column:
    """The element of a list at rank int(round6(q (n - 1)) + 0.5), counted from 0; null for an empty one."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, F.floor(F.round(F.lit(q) * (F.size(values) - 1), 6) + 0.5).cast("int") + 1))


def compare(points: DataFrame, key: str, baseline: Column, symptom: Column, value: str) -> DataFrame:
    """key, baseline, symptom (means), delta (relative), direction, separable: both windows in one pass.

    A zero baseline gives delta 0, which isn't separable.
    """
    means = points.groupBy(key).agg(F.round(F.avg(F.when(baseline, F.col(value))), 6).alias("baseline"), F.round(F.avg(F.when(symptom, F.col(value))), 6).alias("symptom"))
    change = F.when(F.col("baseline") == 0, 0.0).otherwise(F.round((F.col("symptom") - F.col("baseline")) / F.col("baseline"), 6))
    out = means.where("baseline IS NOT NULL AND symptom IS NOT NULL").withColumn("delta", change)
    out = out.withColumn("direction", F.when(F.col("delta") > DIRECTION, "up").when(F.col("delta") < -DIRECTION, "down").otherwise("flat"))
    return out.withColumn("separable", F.abs("delta") >= SEPARABLE)


def errors_by(rows: DataFrame, version: str, error: Column, at: str) -> DataFrame:
    """version, errors, total, rate, first_seen."""
    out = rows.groupBy(version).agg(F.count_if(error).alias("errors"), F.count(F.lit(1)).alias("total"), F.min(at).alias("first_seen"))
    return out.withColumn("rate", F.round(F.col("errors") / F.col("total"), 6))


def concentrated(rates: DataFrame, rate: str, id_: str, factor: float = 2.0) -> DataFrame:
    """The highest rate if it is at least `factor` times the next: only two rows are looked at."""
    two = rates.orderBy(F.desc(rate), id_).limit(2)
    both = two.agg(F.max_by(id_, F.struct(F.col(rate))).alias("top"), F.max(rate).alias("high"), F.min(rate).alias("next"), F.count(F.lit(1)).alias("n"))
    return both.select("top", "high", "next", ((F.col("n") == 1) | (F.col("high") >= factor * F.col("next"))).alias("concentrated"))


def transitions(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose state differs from the one before, with that one as `previous`; a key's first row counts."""
    w = Window.partitionBy(key).orderBy(*order)
    own = states.withColumn("previous", F.lag("state").over(w))
    return own.where(~F.col("state").eqNullSafe(F.col("previous")))


def hysteresis(classes: DataFrame, key: str, order: str, holds: int = 2) -> DataFrame:
    """Changes of class that held for `holds` windows, effective from the first of them."""
    w = Window.partitionBy(key).orderBy(order)
    held = classes.withColumn("_next", F.lead("class", holds - 1).over(w)).withColumn("_low", F.min("class").over(w.rowsBetween(0, holds - 1))).withColumn("_high", F.max("class").over(w.rowsBetween(0, holds - 1)))
    firm = held.where((F.col("_low") == F.col("_high")) & F.col("_next").isNotNull())
    again = Window.partitionBy(key).orderBy(order)
    return firm.withColumn("_before", F.lag("class").over(again)).where(~F.col("class").eqNullSafe(F.col("_before"))).drop("_next", "_low", "_high", "_before")


def absent(windows: DataFrame, key: str, window: str, last: Column, after: int = 6) -> DataFrame:
    """Keys unseen for `after` windows up to `last`, which are retracted at the end of the window that last saw them."""
    seen = windows.groupBy(key).agg(F.max(window).alias("last_seen"))
    return seen.where(last - F.col("last_seen") >= after).withColumn("valid_end", F.col("last_seen") + 1)


def seasonal_baseline(points: DataFrame, key: str, at: str, value: str, period: int, periods: int = 3) -> DataFrame:
    """points with `baseline`: the median of the values one to `periods` periods earlier; null without any.

    Each point is sent forward to the instants that it is history of, so one equi-join finds all history.
    """
    history = points.select(key, F.explode(F.array(*(F.col(at) + F.lit(period * i) for i in range(1, periods + 1)))).alias(at), F.col(value).alias("_past"))
    medians = history.groupBy(key, at).agg(F.median("_past").alias("baseline"))
    return points.join(medians, [key, at], "left")


def _r6(x: float) -> float:
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5) / 1e6, x) if math.isfinite(x) else 0.0


def _sum6(values) -> float:
    total = 0.0
    for v in values:
        total = _r6(total + v)
    return total


def _median(values) -> float:
    s = sorted(values)
    mid = len(s) // 2
    if not s:
        return 0.0
    return s[mid] if len(s) % 2 else _r6(_r6(s[mid - 1] + s[mid]) / 2)


def _spread(values) -> float:
    """Scaled median absolute deviation; mean absolute deviation where that is 0."""
    centre = _median(values)
    off = [_r6(abs(_r6(v - centre))) for v in values]
    return _r6(1.4826 * _median(off)) or _r6(_sum6(off) / max(1, len(off)))


#: Fixed values of the method: drift, alarm, fewest points, effect, points that a shift must last.
DRIFT, ALARM, FEWEST, EFFECT, LASTS, DAY = 0.5, 5.0, 8, 3.0, 5, 86_400
ONSET = "key string, at long, direction string, uncertainty long, effect double, confidence double, reason string"


def _alarm(z: list[float]) -> tuple[int, int, str] | None:
    """(alarm, start of its run, side) of a two-sided CUSUM; up is tested first."""
    sums, starts = {"up": 0.0, "down": 0.0}, {"up": 0, "down": 0}
    for i, x in enumerate(z):
        for side, sign in (("up", 1), ("down", -1)):
            grown = max(0.0, _r6(sums[side] + _r6(sign * x - DRIFT)))
            if sums[side] == 0 and grown > 0:
                starts[side] = i
            sums[side] = grown
        for side in ("up", "down"):
            if sums[side] > ALARM:
                return i, starts[side], side
    return None


def _split(part: list[float]) -> int:
    """The split of a run that tells its two means apart most; the first of equals."""
    n, best, at, left = len(part), -1.0, 0, 0.0
    total = _sum6(part)
    for i in range(1, n):
        left = _r6(left + part[i - 1])
        gap = abs(_r6(_r6(left / i) - _r6(_r6(total - left) / (n - i))))
        score = _r6(gap * _r6(math.sqrt(_r6(i * (n - i) / n))))
        if score > best:
            best, at = score, i
    return at


def onset_of(at: list[int], values: list[float]) -> tuple:
    """(at, direction, uncertainty, effect, confidence, reason) of one series, ascending without repeats."""

    def none(reason):
        return (None, None, None, None, None, reason)

    if not at:
        return none("absent")
    if len(at) < FEWEST:
        return none("too_sparse")
    known = dict(zip(at, values, strict=True))
    past = [[known[t - DAY * i] for i in (1, 2, 3) if t - DAY * i in known] for t in at]
    level = _median(values[: max(1, len(values) // 4)])
    rest = [_r6(v - (_median(p) if p else level)) for v, p in zip(values, past, strict=True)]
    fallback = 2 * sum(bool(p) for p in past) < len(at)
    scale = _spread(rest)
    if not scale:
        return none("flat")
    found = _alarm([_r6(r / scale) for r in rest])
    if not found:
        return none("no_crossing")
    alarm, start, side = found
    low = max(0, start - max(1, alarm - start) - 1)
    change = low + _split(rest[low : alarm + 1]) if alarm > low else alarm
    before, after = values[:change], values[change : change + LASTS]
    if change < 2 or len(values) - change < LASTS:
        return none("no_onset_detected")
    spread = _spread(before)
    if spread:
        moved = _r6(_r6(_sum6(after) / len(after)) - _r6(_sum6(before) / len(before))) * (1 if side == "up" else -1)
        effect = _r6(moved / spread) if moved > 0 else 0.0
        if effect < EFFECT:
            return none("no_onset_detected")
    else:
        effect = 2 * EFFECT
    step = max(1, int(_median([float(b - a) for a, b in zip(at, at[1:], strict=False)])))
    unsure = max(step, (alarm - start) * step) * (2 if fallback else 1)
    return (at[change], side, unsure, effect, min(1.0, max(0.0, _r6(effect / (2 * EFFECT)))), None)


def onset(points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """When each key's series changed for good: seasonal-naive residuals, CUSUM, binary segmentation, effect test.

    Every step rounds to six decimals, so the order of the points matters: a series is one group. Seconds that a series
    has twice keep the last value.
    """
    once = points.groupBy(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at")).agg(F.round(F.last(value), 6).alias("value"))

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("at")
        found = onset_of(series["at"].tolist(), series["value"].tolist())
        return pd.DataFrame([(series["key"].iloc[0], *found)], columns=[c.split()[0] for c in ONSET.split(", ")])

    return once.groupBy("key").applyInPandas(run, ONSET)


def aligned(points: DataFrame, key: str, at: str, value: str, seconds: int, how: str = "mean") -> DataFrame:
    """key, window (its start, epoch-aligned seconds), value, n: a series downsampled by mean, sum, max, min, count or last."""
    window = (F.floor(F.unix_seconds(at) / seconds) * seconds).alias("window")
    agg = {"mean": F.avg(value), "sum": F.sum(value), "max": F.max(value), "min": F.min(value), "count": F.count(value).cast("double"), "last": F.max_by(value, at)}
    if how not in agg:
        raise ValueError(f"no alignment is named {how}")
    return points.groupBy(key, window).agg(F.round(agg[how], 6).alias("value"), F.count(F.lit(1)).alias("n"))


def series_stats(points: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total, mean, most, least of a series."""
    return points.groupBy(key).agg(F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"))


def stopped_flows(compared: DataFrame, fall: float = 0.5) -> DataFrame:
    """Comparisons (before, after, separable) that fell by at least `fall` of what was before."""
    share = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0)
    return compared.withColumn("fall", F.round(share, 6)).where(F.col("separable") & (F.col("after") < F.col("before")) & (F.col("fall") >= fall))


def state_spans(states: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """key, at_start, at_end, transitions of a state over a window: the last state before it, the last in it, and how often it changed inside."""
    order = F.struct(at, "event_id")
    old = Window.partitionBy(key).orderBy(at, "event_id")
    own = states.where(F.col(at) < end).withColumn("_old", F.lag("state").over(old))
    before, inside = F.col(at) < start, F.col(at) >= start
    return own.groupBy(key).agg(F.max_by(F.when(before, F.col("state")), F.when(before, order)).alias("at_start"), F.max_by("state", order).alias("at_end"), F.count_if(inside & ~F.col("state").eqNullSafe(F.col("_old"))).alias("transitions"))


def compare_windows(rows: DataFrame, end: Column, lookback: Column, horizon: Column) -> DataFrame:
    """rows with baseline_from, symptom_from and symptom_to (seconds): each window half the lookback wide, at most 30 minutes,
    15 where the lookback isn't positive; a symptom that ends beyond the horizon slides back to it."""
    half = F.when(lookback > 0, F.least(lookback / 2, F.lit(1800.0))).otherwise(900.0)
    last = F.least(end, horizon)
    return rows.withColumns({"baseline_from": F.round(last - 2 * half, 6), "symptom_from": F.round(last - half, 6), "symptom_to": last})


def latency(samples: DataFrame, family: str, value: str) -> DataFrame:
    """family, n, p50, p95, p99, most, mean of measured latencies, by nearest rank."""
    listed = samples.groupBy(family).agg(F.array_sort(F.collect_list(value)).alias("v"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
    at = lambda q: F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * F.lit(q)).cast("int")))
    return listed.select(family, F.size("v").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "most", "mean")


def error_kinds(spans: DataFrame, operation: str, kind: str, value: str) -> DataFrame:
    """operation, kind, n, mean, p95 of error spans, by what failed and how."""
    listed = spans.groupBy(operation, kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.array_sort(F.collect_list(value)).alias("v"))
    return listed.select(operation, kind, "n", "mean", F.element_at("v", F.ceil(F.size("v") * F.lit(0.95)).cast("int")).alias("p95"))


def median_gaps(points: DataFrame, key: str, at: str) -> DataFrame:
    """key, resolution: the lower median of the seconds between neighbouring points."""
    gap = F.unix_seconds(at) - F.unix_seconds(F.lag(at).over(Window.partitionBy(key).orderBy(at)))
    listed = points.select(key, at).distinct().withColumn("g", gap).where("g IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list("g")).alias("v"))
    return listed.select(key, F.element_at("v", F.ceil(F.size("v") / 2).cast("int")).alias("resolution"))
