"""Approximate nearest neighbours by a hash-prefix forest.

A rotation gives a vector a symbol: the axis and sign nearest to the rotated vector. In each tree a vector has a long
string of such symbols, of rotations in the tree's own order, and the tree is the sorted array of all strings, so the
vectors that share a prefix are a range of it. A query descends to its longest match in every tree and then ascends in
all of them at once, a symbol at a time, until its ranges hold enough vectors, near copies aside; in the last step the
trees where its first symbol is surest ascend first. The vectors of those ranges are scored exactly. A query whose first symbols
alone don't give enough ends at the root, which is every vector.

Each tree is dealt by its first symbols to ranges of about RANGE vectors (a first symbol with more goes in parts), and
a query's string only to the ranges that its prefixes lie in. Vectors that occur many times are one entry with their
smallest ids, as many as can be among a query's results.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import durable

TREES, SYMBOLS = 384, 8
#: A symbol is one of the first so many axes of a rotation, or its opposite.
AXES = 64
#: A search of n vectors ascends until its ranges hold BREADTH * n ** POWER vectors, LEAST at least, repeats counted but those of near copies.
BREADTH, POWER, LEAST = 8, 0.6, 1_000
#: Entries in a range of a tree, in a shard for scoring; queries that ascend together, and that meet a shard together.
RANGE, SHARD, BLOCK, ASKING = 1 << 18, 8_192, 2_048, 16_384
#: Vectors whose strings are worked out at a time, and that leave a task together.
CHUNK, TOGETHER = 256, 16_384


@functools.cache
def rotations(dims: int, seed: int = 11) -> np.ndarray:
    """The first AXES axes of TREES random rotations, side by side."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dims, min(dims, AXES))))[0] for _ in range(TREES)], axis=1).astype(np.float32)


@functools.cache
def orders(seed: int = 12) -> np.ndarray:
    """TREES x SYMBOLS: the rotations that a tree's strings are made of. Each is the first of one tree."""
    rng = np.random.default_rng(seed)
    return np.stack([[t, *rng.choice(np.delete(np.arange(TREES), t), SYMBOLS - 1, replace=False)] for t in range(TREES)])


@dataclass(frozen=True)
class Layout:
    """How strings lie: two symbols an axis, strings of `length` of them, and per tree and first symbol the range and its parts."""

    axes: int
    ranges: np.ndarray | None = None
    parts: np.ndarray | None = None

    @property
    def base(self) -> int:
        return 2 * self.axes

    @property
    def length(self) -> int:
        return min(SYMBOLS, int(63 / np.log2(self.base)))

    @classmethod
    def of(cls, axes: int, cells: np.ndarray) -> Layout:
        """cells: TREES x base, how many vectors have each first symbol."""
        ranges, parts = np.zeros(cells.shape, dtype=np.int32), np.ones(cells.shape, dtype=np.int32)
        for t, row in enumerate(cells):
            at = held = 0
            for symbol, n in enumerate(row.tolist()):
                if held and held + n > RANGE:
                    at, held = at + 1, 0
                held += n
                ranges[t, symbol] = at
                parts[t, symbol] = max(1, -(-n // RANGE))
        return cls(axes, ranges, parts)

    def chance(self, n: int) -> int:
        """The most symbols that some of n vectors are likely to share by chance: one more would make many more strings than vectors."""
        return next((s for s in range(1, self.length - 1) if self.base ** (s + 1) >= 16 * n), self.length - 1)

    def strings(self, codes: np.ndarray, tree: int) -> np.ndarray:
        """codes: rotations x vectors."""
        out = np.zeros(codes.shape[1], dtype=np.int64)
        for r in orders()[tree, : self.length]:
            out = out * self.base + codes[r]
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of an Arrow column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(batches):
    """How many vectors a task has, and their sum."""
    n, total = 0, 0.0
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            n, total = n + len(x), total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "sums"])


def _coded(centre: np.ndarray, blocks: int):
    """id, block, symbols by rotation and trees, the surest first symbol first, of (id, embedding).

    Centred vectors rank alike for any query, as the centre adds one constant to all its products.
    """

    def run(batches):
        dims = len(centre)
        for b in batches:
            codes, sure = [], []
            x = (_matrix(b.column(1)) - centre).astype(np.float32) if b.num_rows else np.empty((0, dims), dtype=np.float32)
            for at in range(0, len(x), CHUNK):
                y = (x[at : at + CHUNK] @ rotations(dims)).reshape(-1, TREES, min(dims, AXES))
                size = np.abs(y)
                axis = size.argmax(axis=2)[:, :, None]
                codes += [r.tobytes() for r in (2 * axis[:, :, 0] + (np.take_along_axis(y, axis, 2)[:, :, 0] > 0)).astype("<u2")]
                sure += [r.tobytes() for r in np.argsort(-np.take_along_axis(size, axis, 2)[:, :, 0], axis=1, kind="stable").astype("<u2")]
            block = pa.array(_block(b.column(0).to_numpy(), blocks).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), block, pa.array(codes, pa.binary()), pa.array(sure, pa.binary())], names=["id", "block", "codes", "sure"])

    return run


def _symbols(column: pa.Array) -> np.ndarray:
    """rotations x vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, TREES).T


def _cells(base: int):
    """(tree, symbol, n) of a task's vectors by first symbol."""

    def run(batches):
        count = np.zeros((TREES, base), dtype=np.int64)
        for b in batches:
            for t, row in enumerate(_symbols(b.column(0))):
                count[t] += np.bincount(row, minlength=base)
        tree, symbol = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(symbol.astype(np.int32)), pa.array(count[tree, symbol])], names=["tree", "symbol", "n"])

    return run


DEALT = "tree int, range int, part int, asks boolean, strings binary, ids binary, levels binary"


def _dealt(layout: Layout, asks: bool):
    """Rows of DEALT, a few for each tree, of (id, codes) or of (id, codes, levels: a byte for each tree)."""

    def rows(ids: np.ndarray, codes: np.ndarray, levels: np.ndarray | None):
        out = {name.split(" ")[0]: [] for name in DEALT.split(", ")}

        def add(t, r, part, at, strings):
            out["tree"].append(t), out["range"].append(r), out["part"].append(part), out["asks"].append(asks)
            out["strings"].append(strings[at].tobytes()), out["ids"].append(ids[at].tobytes())
            out["levels"].append(None if levels is None else levels[at, t].tobytes())

        for t in range(TREES):
            strings = layout.strings(codes, t)
            own, parts = layout.ranges[t][codes[t]], layout.parts[t][codes[t]]
            for r in np.unique(own).tolist():
                at = np.flatnonzero(own == r)
                if levels is not None and not len(at := at[levels[at, t] > 0]):
                    continue
                many = int(parts[at].max())
                if many == 1:
                    add(t, r, 0, at, strings)
                    continue
                dealt = (ids[at].view(np.uint64) >> np.uint64(7)) % parts[at].astype(np.uint64)
                for part in range(many):  # what asks goes to all parts
                    add(t, r, part, at[parts[at] > part] if asks else at[dealt == part], strings)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                levels = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(-1, TREES) if b.num_columns > 2 else None
                held.append((b.column(0).to_numpy(), _symbols(b.column(1)), levels))
                n += b.num_rows
            if n >= TOGETHER:
                yield _joined(held, rows)
                held, n = [], 0
        if held:
            yield _joined(held, rows)

    return run


def _joined(held: list, rows):
    levels = None if held[0][2] is None else np.concatenate([h[2] for h in held])
    return rows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1), levels)


def _numbers(values, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind)


def _tree(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """The sorted array of a range, its entries, the strings that ask and their ids, and their rows."""
    has, asks = rows[~rows["asks"]], rows[rows["asks"]]
    strings, ids = _numbers(has["strings"]), _numbers(has["ids"])
    order = np.argsort(strings)  # a range has all of equal strings or none
    return strings[order], ids[order], _numbers(asks["strings"]), _numbers(asks["ids"]), asks


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)


def _counted(layout: Layout, blocks: int):
    """For each block of queries the numbers of vectors that share 1, 2, ... symbols with each of them in this range of the tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        strings, _, asked, ids, _ = _tree(rows)
        counts = np.empty((len(asked), layout.length), dtype="<i4")
        for level in range(layout.length):
            step = layout.base ** (layout.length - 1 - level)
            low = asked // step * step
            counts[:, level] = np.searchsorted(strings, low + (step - 1), side="right") - np.searchsorted(strings, low)
        block = _block(ids, blocks)
        out = [(int(b), int(rows["tree"].iat[0]), ids[block == b].tobytes(), counts[block == b].tobytes()) for b in np.unique(block)]
        return pd.DataFrame(out, columns=["block", "tree", "ids", "counts"])

    return run


def _placed(blocks: int):
    """id and block of queries."""

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(_block(ids.to_numpy(), blocks).astype(np.int32))], names=["id", "block"])

    return run


def _levels(length: int, enough: int, chance: int, k: int):
    """How many symbols of each tree's string a query keeps when all trees ascend until their ranges hold enough; 0 in all of them is the root.

    What shares more than `chance` symbols with a query are itself and its near copies, found again in tree after tree:
    they don't count. Each entry is in a tree once, so k others are sure when a range holds more than k.
    """

    def run(queries: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(queries["id"].to_numpy())
        counts = np.zeros((len(ids), TREES, length + 1), dtype=np.int64)
        for tree, own, n in zip(counted["tree"], counted["ids"], counted["counts"], strict=True):
            np.add.at(counts, (np.searchsorted(ids, np.frombuffer(own, dtype="<i8")), tree, slice(0, length)), np.frombuffer(n, dtype="<i4").reshape(-1, length))
        out = []
        for q, sure, codes in zip(queries["id"], queries["sure"], queries["codes"], strict=True):
            own, first = counts[np.searchsorted(ids, q)], np.frombuffer(sure, dtype="<u2")
            held = own[:, :-1][first][:, ::-1].T.ravel()  # from the longest prefix to the first symbol, surest trees first
            more = (own[:, :-1] - own[:, 1:])[first][:, ::-1].T.ravel()
            more[: (length - chance) * TREES] = 0
            at = int(np.searchsorted(np.cumsum(more), enough - TREES))  # less the query itself
            at = max(at, int(np.argmax(held > k)) if (held > k).any() else len(more))
            keep = np.zeros(TREES, dtype=np.uint8)
            if at < len(more):
                level, last = length - at // TREES, at % TREES
                keep[first] = np.where(np.arange(TREES) <= last, level, level + 1)
                keep[keep > length] = 0  # not even the whole string is looked for
            out.append((q, codes, keep.tobytes(), at >= len(more)))
        return pd.DataFrame(out, columns=["id", "codes", "levels", "root"])

    return run


def _found(layout: Layout, shards: int, blocks: int):
    """The entries in the queries' ranges, for each shard of entries and block of queries."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        strings, ids, asked, who, asks = _tree(rows)
        level = _numbers(asks["levels"], "u1").astype(np.int64)
        step = layout.base ** (layout.length - level)
        low = asked // step * step
        first = np.searchsorted(strings, low)
        n = np.searchsorted(strings, low + (step - 1), side="right") - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        entry, query = ids[at], np.repeat(who, n)
        place = np.mod(entry, shards).astype(np.uint64) * np.uint64(blocks) + _block(query, blocks)
        order = np.argsort(place.astype(np.uint16) if shards * blocks <= 1 << 16 else place, kind="stable")  # counted, where numbers are small
        place, entry, query = place[order], entry[order], query[order]
        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else [0]
        out = [(int(place[i]) // blocks, int(place[i]) % blocks, query[i:j].tobytes(), entry[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(out, columns=["shard", "block", "queries", "entries"])

    return run


def _met(query: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Distinct pairs of a query's and an entry's place as ascending numbers query * entries + entry: one key to sort, not two."""
    pairs = query * entries + entry
    pairs.sort()
    new = np.ones(len(pairs), dtype=bool)
    np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
    return pairs[new]


def _scored(k: int):
    """The k best of a shard for each query of a block. Rows that ask bring a vector, the others pairs of query and entry; at the root all entries count."""

    def run(entries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        asks, pairs = rows[rows["embedding"].notna()], rows[rows["embedding"].isna()]
        out = {"query_id": [], "vec_id": [], "score": [], "seen": []}
        if len(entries) and len(asks):
            entries = entries.sort_values("h1")
            h1, ids = entries["h1"].to_numpy(), entries["ids"].to_numpy()
            x = np.stack(entries["embedding"].to_numpy()).astype(np.float64)
            who, room = np.sort(asks["query_id"].to_numpy()), np.empty_like(x)
            met = _met(np.searchsorted(who, _numbers(pairs["queries"])), np.searchsorted(h1, _numbers(pairs["entries"])), len(x))
            edges, met = np.searchsorted(met, np.arange(len(who) + 1) * len(x)), met % len(x)
            twins = bool((h1[1:] == h1[:-1]).any())  # two vectors with one hash
            for own, vector, root in zip(asks["query_id"], asks["embedding"], asks["root"], strict=True):
                i = np.searchsorted(who, own)
                at = met[edges[i] : edges[i + 1]]
                if not len(at) and not root:
                    continue
                if root:
                    at = np.arange(len(x))
                elif twins:
                    at = np.concatenate([np.arange(a, b) for a, b in zip(at, np.searchsorted(h1, h1[at], side="right"), strict=True)])
                near = np.take(x, at, axis=0, out=room[: len(at)], mode="clip")  # into memory at hand
                score = np.einsum("ij,j->i", near, np.asarray(vector, dtype=np.float64))
                best = np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1]) if len(score) > k + 1 else np.arange(len(score))
                found = sorted((-score[b], v) for b in best for v in ids[at[b]] if v != own)[:k]
                out["query_id"] += [own] * len(found)
                out["vec_id"] += [v for _, v in found]
                out["score"] += [-s for s, _ in found]
                out["seen"] += [len(at)] * len(found)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "seen": "int64"})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part: an id, the table's most common length, finite components, not all zero."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    number = F.col("embedding")
    bad = F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    own = own.where(~bad & F.exists(number, lambda v: v != 0))
    common = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("embedding") == (common["n"] if common else 0))


def _smallest(k: int):
    """Of each batch at most the k smallest ids of equal vectors."""

    def run(batches):
        for b in batches:
            b = b.sort_values("vec_id").drop_duplicates(["vec_id", "h1", "h2"])
            yield b[b.groupby(["h1", "h2"]).cumcount() < k]

    return run


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, looked_at: the k nearest found of every vector whose vec_id is divisible by `every`.

    Nearness is the inner product in double precision, ties to the smaller vec_id; the query's own row is no
    candidate. looked_at: how many different vectors the query was compared with in the shard of the result. vectors:
    vec_id and embedding among any other columns; see usable() for which take part. Rows repeated
    with one id and vector count once; of an id with several vectors one asks, and all may be found. With too few
    vectors there are fewer than k; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = usable(vectors).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    kind = dict(own.dtypes)["embedding"]
    few = own.mapInPandas(_smallest(k + 1), f"vec_id long, embedding {kind}, h1 long, h2 long")
    # At most k + 1 rows of a vector come from each batch.
    entries = few.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    entries = durable(entries, "ann-entries")
    queries = own.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("embedding", F.struct("h1", "h2")).alias("embedding"))
    queries = durable(queries, "ann-queries")
    sums = entries.select("embedding").mapInArrow(_sums, "n long, sums array<double>").collect()  # a row a task
    if not sums:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, looked_at long")
    n, asked = sum(r["n"] for r in sums), queries.count()
    centre = np.round(np.sum([r["sums"] for r in sums], axis=0) / n, 6)  # rounded: sums depend on how rows were dealt
    blocks, shards = max(1, -(-asked // BLOCK)), max(1, -(-n // SHARD))
    plain, code = Layout(min(len(centre), AXES)), "id long, block int, codes binary, sure binary"
    coded = durable(entries.select("h1", "embedding").mapInArrow(_coded(centre, 1), code).select("id", "codes"), "ann-codes")
    asking = durable(queries.mapInArrow(_coded(centre, blocks), code), "ann-asking")
    cells = np.zeros((TREES, plain.base), dtype=np.int64)
    for r in coded.select("codes").mapInArrow(_cells(plain.base), "tree int, symbol int, n long").groupBy("tree", "symbol").agg(F.sum("n").alias("n")).collect():  # at most trees times symbols
        cells[r["tree"], r["symbol"]] = r["n"]
    layout = Layout.of(plain.axes, cells)
    enough = max(LEAST, int(BREADTH * n**POWER))
    meeting = max(1, -(-asked * min(shards, enough) // (shards * ASKING)))
    has = coded.mapInArrow(_dealt(layout, False), DEALT)
    asks = asking.select("id", "codes").mapInArrow(_dealt(layout, True), DEALT)
    counted = has.unionByName(asks).groupBy("tree", "range", "part").applyInPandas(_counted(layout, blocks), "block int, tree int, ids binary, counts binary")
    levels = asking.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(_levels(layout.length, enough, layout.chance(n), k), "id long, codes binary, levels binary, root boolean")
    levels = durable(levels, "ann-levels")
    asks = levels.where("not root").select("id", "codes", "levels").mapInArrow(_dealt(layout, True), DEALT)
    found = has.unionByName(asks).groupBy("tree", "range", "part").applyInPandas(_found(layout, shards, meeting), "shard int, block int, queries binary, entries binary")
    found = durable(found, "ann-found")
    # A query looks at more vectors than there are shards, so all of a block go wherever one of them goes.
    blocked = asking.mapInArrow(_placed(meeting), "id long, block int").withColumnRenamed("id", "query_id")
    to = found.select("shard", "block").distinct().join(blocked, "block").select("shard", "block", "query_id", F.lit(False).alias("root"))
    roots = levels.where("root").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("block"), F.col("id").alias("query_id"), F.lit(True).alias("root"))
    to = to.join(levels.where("not root").select(F.col("id").alias("query_id")), "query_id", "left_semi").unionByName(roots).join(queries, "query_id").select("shard", "block", "query_id", "embedding", "root", F.lit(None).cast("binary").alias("queries"), F.lit(None).cast("binary").alias("entries"))
    pairs = found.select("shard", "block", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast(kind).alias("embedding"), F.lit(None).cast("boolean").alias("root"), "queries", "entries")
    dealt = entries.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(meeting - 1))).alias("block"), "h1", "embedding", "ids")
    scored = dealt.groupBy("shard", "block").cogroup(to.unionByName(pairs).groupBy("shard", "block")).applyInPandas(_scored(k), "query_id long, vec_id long, score double, seen long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a shard
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("seen").alias("looked_at"))
