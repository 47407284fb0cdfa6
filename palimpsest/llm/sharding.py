"""Sharding by Karmarkar-Karp differencing.

Groups (equal texts) are indivisible. Each task differences blocks of its groups into partial partitions of one sum a
shard; partial partitions are themselves what differencing combines, so a task's blocks are combined next, and at last
one partial partition a task on the driver. The two with the largest spread are always combined, oppositely ordered.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import durable, numbered, partitions

BLOCK = 10_000
LAW = "bytes"


def difference(sums: np.ndarray) -> np.ndarray:
    """Labels for n partial partitions of k sums: entry [i, j] says where the j-th sum of the i-th one goes.

    Works on spreads alone: every combination is shifted so that its smallest sum is 0.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    state = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(n)}
    heap = [(-int(s[0] - s[-1]), i) for i, s in state.items()]
    heapq.heapify(heap)
    merges = []
    for new in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = state.pop(a) + state.pop(b)[::-1]
        by = np.argsort(-total, kind="stable")
        total = total[by]
        total -= total[-1]
        state[new] = total
        merges.append((a, b, by))
        heapq.heappush(heap, (-int(total[0]), new))
    places = {2 * n - 2: np.arange(k)}
    for new in range(2 * n - 2, n - 1, -1):
        a, b, by = merges[new - n]
        own, of_a = places.pop(new), np.empty(k, dtype=np.int64)
        of_a[by] = own
        places[a], places[b] = of_a, of_a[::-1]
    out = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = places[i]
    return out


def _local(shards: int):
    def labelled(some: pd.DataFrame, part: int, block: int) -> pd.DataFrame:
        sums = np.zeros((len(some), shards), dtype=np.int64)
        sums[:, 0] = some["size"]
        return some.assign(label=difference(sums)[:, 0], part=part, block=block)[["digest", "size", "part", "block", "label"]]

    def run(batches):
        part, block, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK:
                yield labelled(pd.concat(held, ignore_index=True), part, block)
                block, held, rows = block + 1, [], 0
        if rows:
            yield labelled(pd.concat(held, ignore_index=True), part, block)

    return run


def _of_task(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, at = np.unique(rows["block"], return_inverse=True)
        sums = np.zeros((len(blocks), shards), dtype=np.int64)
        sums[at, rows["label"]] = rows["size"]
        rows["slot"] = difference(sums)[at, rows["label"]]
        return rows[["part", "block", "label", "size", "slot"]]

    return run


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row a document.

    docs: doc_id and text among any other columns. Size is the text's UTF-8 bytes plus 16; a null text counts as an
    empty one and joins its group. Repeated rows are one group and each keeps a slot; rows without a doc_id take part
    like others. An empty table gives no rows.
    The law is `bytes`: shard sizes near equal, groups whole; grown_shard is null.
    """
    spark, raw = docs.sparkSession, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    meta = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("digest"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))), F.monotonically_increasing_id()).alias("spread"),
    )
    meta = durable(meta, "shard-rows")
    groups = meta.groupBy("digest").agg(F.sum("size").alias("size"))
    local = durable(groups.mapInPandas(_local(shards), "digest binary, size long, part int, block int, label int"), "shard-groups")
    sums = local.groupBy("part", "block", "label").agg(F.sum("size").alias("size"))
    tasks = durable(sums.groupBy("part").applyInPandas(_of_task(shards), "part int, block int, label int, size long, slot int"), "shard-parts")
    rows = tasks.groupBy("part", "slot").agg(F.sum("size").alias("size")).toPandas()  # one row a task and shard
    parts, at = np.unique(rows["part"], return_inverse=True)
    table = np.zeros((len(parts), shards), dtype=np.int64)
    table[at, rows["slot"].to_numpy(dtype=np.int64)] = rows["size"]
    labels = difference(table) if len(parts) else np.empty((0, shards), dtype=np.int64)
    final = [(int(p), s, int(labels[i, s])) for i, p in enumerate(parts) for s in range(shards)]
    of_slot = spark.createDataFrame(final, "part int, slot int, shard int")
    of_label = tasks.join(F.broadcast(of_slot), ["part", "slot"]).select("part", "block", "label", "shard")
    of_group = local.join(of_label, ["part", "block", "label"]).select("digest", "shard")
    placed = meta.join(of_group, "digest").withColumn("_part", F.pmod("spread", F.lit(partitions(spark))).cast("int")).drop("digest", "spread")
    slots = numbered(placed, "shard", "_part", ["doc_id", "text_crc32"], "slot", "shard-slots")
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
