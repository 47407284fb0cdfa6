"""Best-fit packing by minimum bin slack.

Documents are encoded; only those longer than a sequence are cut. What is packed is the histogram of piece lengths, at
most `size` numbers whatever the corpus, so the plan is made on the driver in bounded memory: for each sequence the
longest length left opens it, a bitset subset-sum over the lengths left finds the fullest filling, and that combination
is removed as many times as the counts allow. Pieces then take their places by rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import durable
from palimpsest.llm.encoding import encoder
from palimpsest.llm.remembered import giving_back

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"


def _pieces(path: str, lower: bool, end: int, size: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some, encode, rows = batch.slice(i, 256), encoder(path, lower, end), []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = encode(text)
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        n = len(own) // 4
                        rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"])

    return run


def fullest(room: int, counts: np.ndarray) -> list[int]:
    """Lengths, longest first, of a combination that fills `room` as far as the counts allow.

    Bit s of a Python integer says that sum s can be made. Lengths come in descending order, each as many times as
    it is there and fits; the bitset before each addition is kept to walk back. It ends early when `room` is met.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        copies, lot = min(int(counts[length]), room // length), 1
        while copies > 0:  # lots of 1, 2, 4, ... copies make any number
            lot = min(lot, copies)
            copies -= lot
            steps.append((length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            lot *= 2
        if reach >> room & 1:
            break
    left, found = reach.bit_length() - 1, []
    for length, lot, before in reversed(steps):
        if not before >> left & 1:
            found += [length] * lot
            left -= length * lot
    return sorted(found, reverse=True)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, list[int]]]:
    """(first sequence, how many sequences, lengths in each) until every length is used up.

    Every entry uses up at least one length, so there are at most `size` entries, however many pieces there are.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out, at = [], 0
    for longest in range(size, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            lengths = [longest, *fullest(size - longest, counts)]
            counts[longest] += 1
            used, times = np.unique(lengths, return_counts=True)
            repeat = int((counts[used] // times).min())
            counts[used] -= repeat * times
            out.append((at, repeat, lengths))
            at += repeat
    return out


def places(made: list[tuple[int, int, list[int]]]) -> pd.DataFrame:
    """length, rank, n, sequence, offset, run: the n pieces of that length from that rank on go to the sequences from
    `sequence` on at that offset. One row for each place in a plan entry."""
    rows, ranks = [], {}
    for first, repeat, lengths in made:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            rows.append((length, rank, repeat, first, offset))
            ranks[length] = rank + repeat
            offset += length
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def _place(table: pd.DataFrame, size: int):
    """Places for (length, rank) rows, by binary search in the plan's ranks."""
    shift = 1 << 48
    keys = (table["length"] * shift + table["rank"]).to_numpy()
    first, sequence, offset = (table[c].to_numpy() for c in ("rank", "sequence", "offset"))

    def run(batches):
        for b in batches:
            rank = b["rank"].to_numpy()
            at = np.searchsorted(keys, b["length"].to_numpy() * shift + rank, side="right") - 1
            b["sequence_id"], b["offset"] = sequence[at] + rank - first[at], offset[at]
            yield b.drop(columns="rank")

    return run


def pack(docs: DataFrame, vocabulary: str, end: int = 1, *, lower: bool = True, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    docs: doc_id and text among any other columns. A null or empty text is its end id alone. Repeated rows are
    packed each for itself, also under one doc_id. An empty table gives no rows. Which of equally long pieces goes
    where depends on the input's partitions; the number of sequences doesn't.
    """
    if size >= 1 << 15:
        raise ValueError("size must be under 32768")
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = durable(plain.mapInArrow(giving_back(_pieces(vocabulary, lower, end, size)), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = places(plan(histogram, size))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank_in_part")).alias("rank"))
    return ranked.mapInPandas(_place(table, size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
