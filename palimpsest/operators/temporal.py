"""Bitemporal predicates and joins. Intervals are half-open, [from, to); a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Levels of buckets of an interval join, each so many times as wide as the one before.
LEVELS, STEP = 4, 32


def contains(start: str | Column, end: str | Column, instant: Column) -> Column:
    """start <= instant < end."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return (start <= instant) & (end.isNull() | (instant < end))


def valid_at(instant: Column) -> Column:
    return contains("valid_from", "valid_to", instant)


def observed_at(instant: Column) -> Column:
    return contains("observed_from", "observed_to", instant)


def as_of(df: DataFrame, valid: Column, observed: Column | None = None) -> DataFrame:
    """The rows valid at one instant, as known at another; both filters reach the scan."""
    out = df.where(valid_at(valid))
    return out if observed is None else out.where(observed_at(observed))


def valid_in(after: Column, until: Column) -> Column:
    """Overlap with (after, until]."""
    return (F.col("valid_from") <= until) & (F.col("valid_to").isNull() | (F.col("valid_to") > after))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (b_to.isNull() | (a_from < b_to)) & (a_to.isNull() | (b_from < a_to))


def intersection(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> tuple[Column, Column]:
    """Bounds of the common part; least() leaves open ends open only if both are."""
    return F.greatest(a_from, b_from), F.least(a_to, b_to)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], seconds: int, horizon: Column) -> DataFrame:
    """Pairs of rows that share `on` and whose [valid_from, valid_to) overlap; right columns get the prefix r_.

    Each interval is dealt to the time buckets that it touches, so the join is an equi-join on (on, level, bucket) with a
    residual test, not a product. seconds is the bucket width of the first level: about the usual length of an interval.
    Each further level is STEP times wider. An interval has the first level in which it touches at most STEP buckets, and is
    dealt there and in all wider levels, so long and open ones give few rows; a pair meets in the wider level of the two,
    in the first bucket that both touch. Open ends reach to `horizon`.
    """

    def dealt(df: DataFrame) -> DataFrame:
        start, end = F.unix_seconds("valid_from"), F.unix_seconds(F.coalesce("valid_to", horizon))
        widths = F.array(*(F.lit(seconds * STEP**i).cast("long") for i in range(LEVELS)))
        buckets = lambda i, t: F.floor(t / F.get(widths, i))
        own = F.lit(LEVELS - 1)
        for i in reversed(range(LEVELS - 1)):
            own = F.when(end - start < seconds * STEP ** (i + 1), i).otherwise(own)

        def places(i: Column) -> Column:
            first = buckets(i, F.col("_start"))
            return F.transform(F.sequence(first, F.greatest(first, buckets(i, F.col("_end")))), lambda b: F.struct(i.alias("level"), b.alias("bucket"), first.alias("first"), (i == F.col("_own")).alias("own")))

        spread = df.withColumn("_start", start).withColumn("_end", end).withColumn("_own", own)
        return spread.withColumn("_at", F.explode(F.flatten(F.transform(F.sequence(F.col("_own"), F.lit(LEVELS - 1)), places)))).drop("_start", "_end", "_own").withColumns({"_level": F.col("_at.level"), "_bucket": F.col("_at.bucket")})

    r = dealt(right)
    r = r.select(*(F.col(c).alias(c if c in on or c in ("_level", "_bucket") else f"r_{c}") for c in r.columns))
    joined = dealt(left).join(r, [*on, "_level", "_bucket"])
    hit = overlaps(F.col("valid_from"), F.col("valid_to"), F.col("r_valid_from"), F.col("r_valid_to"))
    once = (F.col("_at.own") | F.col("r__at.own")) & (F.col("_bucket") == F.greatest("_at.first", "r__at.first"))
    return joined.where(hit & once).drop("_at", "r__at", "_level", "_bucket")


def asof_join(points: DataFrame, rows: DataFrame, on: str, at: str, time: str, order: str, take: list[str]) -> DataFrame:
    """points, each with the columns `take` of the latest row with the same key and time <= its own.

    One shuffle: both sides are stacked, and last(ignore nulls) carries the latest row forward. A row counts at its
    own instant; equal instants go by `order`.
    """
    value = F.struct(*take)
    stacked = points.select(F.col(on), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_o"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(rows.select(value).schema[0].dataType).alias("_row")).unionByName(
        rows.select(F.col(on), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(order).cast("long").alias("_o"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"), value.alias("_row"))
    )
    carry = Window.partitionBy(on).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_row", F.last("_row", ignorenulls=True).over(carry)).where(F.col("_side") == 1)
    return found.select("_point.*", *(F.col("_row").getField(c).alias(c) for c in take))


def latest_before(df: DataFrame, key: str, time: str, order: str, instant: Column) -> DataFrame:
    """Each key's latest row at or before an instant, by one aggregate: no sort of the group."""
    best = df.where(F.col(time) <= instant).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(time, order)).alias("_r"))
    return best.select("_r.*")


def islands(df: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Runs of adjacent equal content: key, content, valid_from, valid_to, n_rows."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(content).eqNullSafe(F.lag(content).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "_run", content).agg(F.min("valid_from").alias("valid_from"), F.max_by("valid_to", F.struct(*order)).alias("valid_to"), F.count(F.lit(1)).alias("n_rows"))
    return out.drop("_run")


def overlapping(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows that begin before an earlier row of the key has ended."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.col("valid_to").isNull().cast("int")).over(before)
    reach = F.max("valid_to").over(before)
    return df.withColumn("_reach", reach).withColumn("_open", open_before).where((F.col("_open") == 1) | (F.col("valid_from") < F.col("_reach"))).drop("_reach", "_open")


def split_at(df: DataFrame, instant: Column) -> DataFrame:
    """Rows that contain an instant in their inside become two."""
    inside = (F.col("valid_from") < instant) & (F.col("valid_to").isNull() | (instant < F.col("valid_to")))
    whole = F.struct(F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))
    parts = F.when(inside, F.array(F.struct(F.col("valid_from").alias("f"), instant.alias("t")), F.struct(instant.alias("f"), F.col("valid_to").alias("t")))).otherwise(F.array(whole))
    rest = [c for c in df.columns if c not in ("valid_from", "valid_to")]
    return df.select(*rest, F.explode(parts).alias("_p")).select(*rest, F.col("_p.f").alias("valid_from"), F.col("_p.t").alias("valid_to"))
