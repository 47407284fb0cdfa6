"""Streams in several batches: late rows, heartbeats, timers, order and resumption."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.streaming import topology as op

START = datetime(2024, 1, 1)


def batches(spark, path, schema, *parts):
    """A stream whose micro-batches are the given rows, one file each."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "ts timestamp, src string, dst string, p double"
    row = lambda t: (at(t), "a", "b", 0.5)
    spans = batches(spark, f"{tmp_path}/in", schema, [row(1), row(2)], [row(60)], [row(61)], [row(3)], *([(at(600 + i), op.HEARTBEAT, None, None)] for i in range(3)))
    told, late = op.run_counting(op.windowed_calls(spans), f"{tmp_path}/out")
    got = {r["start"]: (r["calls"], r["weight"]) for r in told.collect()}
    assert got == {at(0): (2, 4), at(60): (2, 4)} and late >= 1


def test_timer_retracts_what_never_returns(spark, tmp_path):
    rows = lambda w, *keys: [(k, w, c, START + timedelta(days=w)) for k, c in keys]
    schema = "key string, window long, class int, at timestamp"
    base = (START - datetime(1970, 1, 1)).days
    shift = lambda part: [(k, base + w, c, t) for k, w, c, t in part]
    parts = [shift(rows(w, ("x", 2), *([("y", 3)] if w < 3 else []))) for w in range(14)]
    stream = batches(spark, f"{tmp_path}/in", schema, *parts).withWatermark("at", "0 seconds")
    got = {(r["key"], r["kind"], r["class"], r["window"] - base) for r in op.run_available(op.edge_events(stream, 86400), f"{tmp_path}/out").collect()}
    assert got == {("x", "set", 2, 0), ("y", "set", 3, 0), ("y", "retract", 3, 3)}


def test_order_within_the_tolerance(spark, tmp_path):
    schema = "key string, at timestamp, seq long"
    stream = batches(spark, f"{tmp_path}/in", schema, [("k", at(5), 2), ("k", at(9), 4)], [("k", at(1), 1), ("k", at(7), 3)], [("k", at(100), 5)], [("z", at(300), 9)], [("z", at(301), 10)])
    path = f"{tmp_path}/out"
    seen = []
    q = op.in_order(stream.withWatermark("at", "10 minutes")).writeStream.foreachBatch(lambda b, i: seen.extend(r["seq"] for r in b.where("key = 'k'").collect())).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [1, 2, 3, 4, 5]


def test_follow_resumes(spark, tmp_path):
    schema, seen = "id long", []
    stream = batches(spark, f"{tmp_path}/in", schema, [(1,), (2,)], [(3,)])
    op.follow(stream, f"{tmp_path}/out", lambda b, i: seen.append(sorted(r["id"] for r in b.collect())))
    spark.createDataFrame([(4,)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    op.follow(stream, f"{tmp_path}/out", lambda b, i: seen.append(sorted(r["id"] for r in b.collect())))
    assert [s for s in seen if s] == [[1, 2], [3], [4]]


def test_first_delivery_stands(spark):
    rows = spark.createDataFrame([(1, at(5), "late"), (1, at(1), "first"), (2, at(3), "only")], "id long, ts timestamp, what string")
    assert {(r["id"], r["what"]) for r in op.deduplicated(rows, "id", "ts").collect()} == {(1, "first"), (2, "only")}
    assert op.deduplicated(rows.withColumn("seq", F.length("what")), "id", "ts", arrival="seq").where("id = 1").first()["what"] == "late"
