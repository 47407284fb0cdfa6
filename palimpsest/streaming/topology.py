"""Structured Streaming operators: windowed topology, deduplicated append, hysteresis, absence and changes by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

WINDOW, LATENESS = "5 minutes", "5 minutes"
#: Windows that a class must hold to be told, and windows without a sighting after which a key is retracted.
HOLDS, ABSENT = 2, 6
#: The source of a heartbeat: no edge has it.
HEARTBEAT = ""


def windowed_calls(spans: DataFrame, at: str = "ts") -> DataFrame:
    """start, src, dst, calls, weight per tumbling window, epoch-aligned; late spans beyond the watermark are dropped and counted (see late_rows)."""
    own = spans.withWatermark(at, LATENESS) if spans.isStreaming else spans
    grouped = own.groupBy(F.window(at, WINDOW).alias("w"), "src", "dst").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(1.0 / F.col("p"))).cast("long").alias("weight"), F.max(F.col("src") != HEARTBEAT).alias("real"))
    # An aggregate, as a filter on src itself would go below the watermark and take the heartbeats before they move it.
    return grouped.where("real").select(F.col("w.start").alias("start"), "src", "dst", "calls", "weight")


def heartbeat(spark: SparkSession, at: Column, like: DataFrame, ts: str = "ts") -> DataFrame:
    """One row of the schema of `like` that only moves time: an idle or ending source sends it, and windows before it close."""
    fields = [at.alias(ts) if f.name == ts else F.lit(HEARTBEAT).alias(f.name) if f.name == "src" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return spark.range(1).select(*fields)


def deduplicated(events: DataFrame, key: str, at: str, within: str = "1 day", arrival: str | None = None) -> DataFrame:
    """First delivery of each key. A stream drops redeliveries within the watermark; a batch keeps the first by `arrival` (else by `at`)."""
    if events.isStreaming:
        return events.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
    order = Window.partitionBy(key).orderBy(arrival or at)
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


EMITTED, STATE = "key string, kind string, class int, window long", "class int, pending int, pending_window long, last long"
_NONE = (-1, -1, -1, -1)


def edge_step(held: tuple, window: int, class_: int) -> tuple[tuple, list[tuple]]:
    """The state after a window of a key, and what it tells: (kind, class, window) each."""
    now, pending, pending_window, last = held
    out = []
    if last >= 0 and window - last > ABSENT and now >= 0:
        out.append(("retract", now, last + 1))
        now, pending, pending_window = -1, -1, -1
    if class_ == now:
        pending = -1
    elif class_ == pending:
        now, pending = class_, -1
        out.append(("set", now, pending_window))
    else:
        pending, pending_window = class_, window
    return (now, pending, pending_window, max(last, window)), out


def edge_events(windows: DataFrame, seconds: int) -> DataFrame:
    """key, kind, class, window: a class is told once it has held HOLDS windows, from the first of them; a key without a sighting
    for ABSENT windows is retracted when time has passed them, whether or not it comes back.

    windows: key, window (number), class, at (the window's start), with a watermark on `at`; seconds: a window's width.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = state.get if state.exists else _NONE, []
        if state.hasTimedOut:
            if held[0] >= 0:
                out.append((key[0], "retract", held[0], held[3] + 1))
            held = (-1, -1, -1, held[3])
            state.update(held)
        else:
            rows = pd.concat(list(batches), ignore_index=True)
            for window, class_ in rows.sort_values("window")[["window", "class"]].itertuples(index=False):
                held, told = edge_step(held, int(window), int(class_))
                out += [(key[0], *t) for t in told]
            state.update(held)
            # A timer: event time past the last window that may still bring a sighting.
            due = (held[3] + ABSENT + 1) * seconds * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame(out, columns=["key", "kind", "class", "window"])

    return windows.groupBy("key").applyInPandasWithState(run, EMITTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


CHANGED = "key string, old string, new string, at timestamp"


def changed_only(rows: DataFrame) -> DataFrame:
    """key, old, new, at: a row (key, fingerprint, at) is told only when its key's fingerprint differs from the last one told; old is null at first.

    Nodes and claims are emitted once and again only as they change; with a version as fingerprint this tells rollouts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "fingerprint"])
        for print_, at in rows[["fingerprint", "at"]].itertuples(index=False):
            if print_ != last:
                out.append((key[0], last, print_, at))
                last = print_
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["key", "old", "new", "at"])

    return rows.groupBy("key").applyInPandasWithState(run, CHANGED, "last string", "append", GroupStateTimeout.NoTimeout)


ORDERED = "key string, at timestamp, seq long"


def in_order(rows: DataFrame) -> DataFrame:
    """key, at, seq of rows (with a watermark on `at`) in order of (at, seq) within a key: each waits until the watermark has passed it, so what comes late within the tolerance takes its place."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            new = pd.concat(list(batches), ignore_index=True)
            held += [(int(pd.Timestamp(at).value // 1000), int(seq)) for at, seq in new[["at", "seq"]].itertuples(index=False)]
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ready, rest = [h for h in held if h[0] <= passed], [h for h in held if h[0] > passed]
        if rest:
            state.update(([h[0] for h in rest], [h[1] for h in rest]))
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="us"), seq) for at, seq in ready], columns=["key", "at", "seq"])

    return rows.groupBy("key").applyInPandasWithState(run, ORDERED, "ats array<long>, seqs array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _started(df: DataFrame, path: str) -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()


def run_available(df: DataFrame, path: str) -> DataFrame:
    """Run a streaming DataFrame in append mode over what is there now, into Parquet files under path, and read them. A second run over the same path goes on where the first ended."""
    q = _started(df, path)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def late_rows(q: StreamingQuery) -> int:
    """Rows that a query's watermark has dropped so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])


def run_counting(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """run_available() with the number of late rows."""
    q = _started(df, path)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows"), late_rows(q)


def follow(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every new batch of a log to `handle`, once each by batch id, as far as there are any now: a handler that records the id can skip one that comes again."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/follow").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
