"""Token ids as Parquet list columns.

Each file holds a run of documents in ascending doc_id; row groups and pages have set sizes, and Parquet's column and
offset indexes let a reader take the token lists, or only the metadata, of the documents that it asks for. Ids are
dictionary encoded (a vocabulary is small) or, on request, delta encoded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions, shared_path
from palimpsest.llm.encoding import encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
_IN_ONE_BATCH = 128


def _encode(path: str, lower: bool, end: int):
    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, _IN_ONE_BATCH):
                some, encode = batch.slice(i, _IN_ONE_BATCH), encoder(path, lower, end)
                ids = [encode(t) for t in some.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at + bounds[:-1]), pa.array(n), tokens],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
                )
                at += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int, *, lower: bool = False, ids: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 1000) -> None:
    """Encode every whole text (null: empty), add the end id, write to `path` in ascending doc_id order.

    docs: doc_id and text among any other columns. Rows without a doc_id come first; rows with equal doc_id are
    all kept, by text. An empty table gives files without rows. ids: "dictionary" or "delta".
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = plain.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        dealt.mapInArrow(_encode(vocabulary, lower, end), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(ids == "dictionary").lower())
        .option("parquet.writer.version", "v2" if ids == "delta" else "v1")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens of every document; token pages are not read."""
    return spark.read.schema(SCHEMA).parquet(path).drop("tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The documents with first <= doc_id <= last; row groups and pages outside are skipped by their indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, first: how many ids stand in the files before a part's. One row a write task."""
    sums = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    pairs, at = [], 0
    for row in sums.orderBy("part").collect():  # one row a write task
        pairs.append((row["part"], at))
        at += row["n"]
    return spark.createDataFrame(pairs, "part int, first long")


def _crc(batches):
    for batch in batches:
        lists = batch.column(3)
        values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the files."""
    rows = read_tokens(spark, path).join(F.broadcast(part_starts(spark, path)), "part")
    rows = rows.select("doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files, read them back, return token_digests()."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return token_digests(docs.sparkSession, path)
