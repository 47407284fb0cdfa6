"""N-gram Jaccard join by parity sketches.

A text's set of shingles is XOR-hashed into a bit sketch: each shingle flips one bit of one of c chunks of 2 ** 32 bits,
so two sketches differ in no more bits, and in no more chunks, than the sets differ in shingles. Sketches are sparse, and
a chunk's odd bits are folded into a 64-bit key. At a similarity of t or more, sets of a and b shingles differ in at most
(a + b)(1 - t) / (1 + t); the smaller has at least t times the larger. So each set emits, of its c keys in one order for
all sets, the first D + 1 (D: the most it may differ from any partner): two linked sets have one of them in common, and
min(D of both) + 1 less their own most difference at least. Layouts go by size band; a set near the lower end of its
band emits in the band below too.

Any order will do, as long as it is one order: keys that many sets have come late, the most frequent last but for empty
chunks, so that a passage which many documents share joins only those that hardly have anything else. Equal sets count
once. Sets with a key in common are compared with one of them first, the one that shares most keys with others, as the
text that copies were made of does; links make components. A set outside that one's component then meets the others of
its keys, and a pair is made of them only if small dense parity sketches, whose Hamming distance is a lower bound of the
sets' difference, allow a link. Those pairs are compared by the shingle hashes of the whole texts. Keys of many sets go
through the join in blocks, so no task has all sets of a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import durable, packed, partitions, unpacked
from palimpsest.llm.components import components
from palimpsest.llm.remembered import giving_back
from palimpsest.llm.shingles import mixed, shingle_sets

WORDS, PERCENT = 5, 80
#: Sizes from 2 ** k to 2 ** (k + 1) - 1 are a band; its layout has a fifth more chunks than its largest sets may differ in.
BAND = 2
#: Texts of so many bytes are worked on at a time.
SLICE = 1 << 18
#: Keys are counted in blocks of COUNTED, and combined before they leave a task in blocks of KEYS; a batch of them has at most ROWS.
COUNTED, KEYS, ROWS = 2_500_000, 600_000, 50_000
#: Up to so many classes the texts to compare are found by a broadcast of their ids (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Keys that a block of texts has more than once are frequent, and so many of them, the most frequent, come late in the
#: order (16 bytes each). This changes what is compared, never what is found.
MOST_FREQUENT = 1_000_000
#: Sets of one key meet in blocks of so many. Those of a key of up to FEW sets meet without sketches.
MEET, FEW = 2_000, 12


def differing(n, percent: int = PERCENT):
    """The most shingles in which a set of n can differ from a partner: partners have at most 100 n / percent."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The bands in whose layouts a set of n emits: its own, and the one below if a partner may be there."""
    own = n.bit_length() - 1
    return [own, own - 1] if own and -(-n * percent // 100) < BAND**own else [own]


def chunks(band: int, percent: int = PERCENT) -> int:
    return int(differing(BAND ** (band + 1), percent)) * 6 // 5 + 1


def chunk_keys(hashes: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the chunks with an odd bit, their numbers) of an ascending set in a band's layout."""
    chunk = ((hashes >> np.uint64(32)) * np.uint64(chunks(band, percent))) >> np.uint64(32)  # ascending, as the hashes are
    starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    value = np.bitwise_xor.reduceat(mixed(hashes & np.uint64(0xFFFFFFFF)), starts)  # a bit that is hit twice is even again
    odd = value != 0
    at = chunk[starts][odd]
    return mixed(mixed(at + mixed(np.uint64([band + 1]))[0]) ^ value[odd]), at


def emitted(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All keys that a set emits, as many of them in each of its bands(). A set that can only be linked with equal ones emits none.

    frequent: frequent keys, ascending; rank: their places in the order behind all others.
    """
    n = len(hashes)
    most = int(differing(n, percent))
    out = [np.empty(0, dtype=np.uint64)]
    for band in bands(n, percent) if most else []:
        keys, at = chunk_keys(hashes, band, percent)
        place = np.zeros(len(keys), dtype=np.int64)
        if len(frequent):
            i = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
            place = np.where(frequent[i] == keys, rank[i] + 1, 0)
        keys = keys[np.lexsort((keys, place))]
        if len(keys) <= most:
            empty = np.setdiff1d(np.arange(chunks(band, percent), dtype=np.uint64), at, assume_unique=True)
            rest = mixed(mixed(mixed(empty + mixed(np.uint64([band + 1]))[0])))
            rest.sort()
            keys = np.concatenate([keys, rest])
        out.append(keys[: most + 1])
    return np.concatenate(out)


def dense(hashes: np.ndarray) -> np.ndarray:
    """A parity sketch of 2 to 4 bits a shingle, as many for all sets of a band, as 64-bit words."""
    bits = max(64, BAND ** (max(1, len(hashes)).bit_length() + 1))
    odd = (np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def folded(sketch: Column) -> Column:
    """The sketch with half the bits, as sets of the band below have it: parities add up."""
    half = (F.size(sketch) / 2).cast("int")
    return F.when(F.size(sketch) < 2, sketch).otherwise(F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q)))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two dense sketches of one length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda x, y: x + y)


def _slices(batch: pa.RecordBatch, column: int):
    """Slices of a batch of about SLICE bytes of text, at least a row each."""
    at, sizes = 0, np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batch: pa.RecordBatch, words: int):
    """For each slice of a batch: its doc_ids, and hashes, bounds, n, h1, h2 of its texts' sets."""
    for b in _slices(batch, 1):
        hashes, bounds = shingle_sets(b.column(1), words)
        n = np.diff(bounds)
        full = n > 0
        h1, h2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
        if len(hashes):
            starts = bounds[:-1][full]
            h1[full] = mixed(np.add.reduceat(mixed(hashes), starts) + n[full].astype(np.uint64))
            h2[full] = mixed(np.add.reduceat(mixed(hashes ^ np.uint64(0x5DEECE66D)), starts))
        yield b.column(0), hashes, bounds, n, h1, h2


def _fresh(seen: set, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> list[int]:
    """Rows whose set isn't in `seen` yet, which then is."""
    out = []
    for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
        if n[i] and key not in seen:
            seen.add(key)
            out.append(i)
    return out


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that an array has several times, ascending, and how many times. Sorts the array, which may be a task's largest, in place."""
    keys.sort()
    same = np.zeros(len(keys) + 1, dtype=bool)  # as the key before
    same[1:-1] = keys[1:] == keys[:-1]
    first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
    return keys[first], last - first + 1


def _counted(words: int, percent: int):
    """doc_id, n, h1, h2 of every text; on a block's last row the keys that several of its sets have, and how many."""

    def run(batches):
        seen, keys, parts, held = set(), np.empty(COUNTED, dtype=np.uint64), [], 0

        def block():
            key, count = repeats(keys[:held])
            for j, (ids, n, h1, h2) in enumerate(parts):
                ends = np.zeros(len(n) + 1, dtype=np.int32)
                last = j == len(parts) - 1
                ends[-1] = len(key) if last else 0
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (_signed(key if last else key[:0]), pa.array(count if last else count[:0]))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), _signed(h1), _signed(h2), *lists], names=["doc_id", "n", "h1", "h2", "keys", "counts"])

        for ids, hashes, bounds, n, h1, h2 in (x for batch in batches for x in _sets(batch, words)):
            for i in _fresh(seen, h1, h2, n):
                own = hashes[bounds[i] : bounds[i + 1]]
                for band in bands(len(own), percent) if differing(len(own), percent) else []:
                    more = chunk_keys(own, band, percent)[0]
                    if held + len(more) > len(keys):
                        keys = np.concatenate([keys[:held], np.empty(len(more) + COUNTED // 8, dtype=np.uint64)])
                    keys[held : held + len(more)] = more
                    held += len(more)
            # A slice of a column would keep the texts of its batch.
            parts.append((ids.take(pa.array(np.arange(len(ids)))), n, h1, h2))
            if held >= COUNTED:
                yield from block()
                seen, parts, held = set(), [], 0
        if parts:
            yield from block()

    return run


KEYED = "key long, c long, n int, own boolean, kind int"
_HUB, _SHARED_HUB, _MORE = 0, 1, 2


def _emitting(words: int, percent: int, late):
    """Rows (key, c, n, own, kind) of each block: of every key its smallest class hash c as hub, and what more has the key.

    late: broadcast (frequent keys, their ranks); own: the key is of the set's own band's layout.
    """

    def run(batches):
        seen, keys, owns, c, n, held = set(), [], [], [], [], 0

        def block():
            of = np.argsort(np.array(c, dtype=np.int64))
            rank = np.empty(len(of), dtype=np.int32)
            rank[of] = np.arange(len(of), dtype=np.int32)
            key, own = np.concatenate(keys).view(np.int64), np.concatenate(owns)
            at = np.repeat(rank, [len(k) for k in keys])
            order = np.lexsort((at, key))
            key, at, own = key[order], at[order], own[order]
            same = key[1:] == key[:-1]
            kind = np.full(len(key), _HUB, dtype=np.int32)
            kind[:-1][same] = _SHARED_HUB
            kind[1:][same] = _MORE
            classes, sizes = np.array(c, dtype=np.int64)[of], np.array(n, dtype=np.int32)[of]
            for i in range(0, len(key), ROWS):
                some = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[some], classes[at[some]], sizes[at[some]], own[some], kind[some])], names=["key", "c", "n", "own", "kind"])

        for _, hashes, bounds, size, h1, h2 in (x for batch in batches for x in _sets(batch, words)):
            for i in _fresh(seen, h1, h2, size):
                given = emitted(hashes[bounds[i] : bounds[i + 1]], *late.value, percent)
                if len(given):
                    keys.append(given)
                    owns.append(np.arange(len(given)) <= int(differing(int(size[i]), percent)))
                    c.append(int(h1[i : i + 1].view(np.int64)[0]))
                    n.append(int(size[i]))
                    held += len(given)
            if held >= KEYS:
                yield from block()
                seen, keys, owns, c, n, held = set(), [], [], [], [], 0
        if keys:
            yield from block()

    return run


def _repeated(batches):
    """Of rows sorted by key and c: hubs whose key has another hub or that are shared, and all that isn't a hub. Holds one batch and one row."""
    names, held = ["key", "c", "n", "own"], None
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        kind = b.column(4).to_numpy()
        more = kind == _MORE
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in columns], names=names)
        columns, due = [x[~more] for x in columns], (kind == _SHARED_HUB)[~more]
        if held is not None:
            columns = [np.concatenate([h, x]) for h, x in zip(held[0], columns, strict=True)]
            due = np.concatenate([[False], due])
        if not len(due):
            continue
        same = columns[0][1:] == columns[0][:-1]
        due[1:] |= same
        due[:-1] |= same
        if held is not None:
            due[0] &= not held[1]
        held = [x[-1:] for x in columns], bool(due[-1]) or (held is not None and len(due) == 1 and held[1])
        yield pa.RecordBatch.from_arrays([pa.array(x[due]) for x in columns], names=names)


def _content(words: int, whole: bool):
    """h1, h2, n of every text's set, and its hashes if `whole`, else its dense sketch."""

    def run(batches):
        for batch in batches:
            for _, hashes, bounds, n, h1, h2 in _sets(batch, words):
                own = [hashes[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                last = pa.array([x.astype("<u8").tobytes() for x in own], pa.binary()) if whole else pa.array([dense(x) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(n), last], names=["h1", "h2", "n", "hashes" if whole else "sketch"])

    return run


def _linked(percent: int):
    """Of rows (a, b, ha, hb, na, nb, x, y) the first four, where the sets of hashes x and y link."""

    def test(na, nb, x, y) -> bool:
        x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
        both = int((y[np.minimum(np.searchsorted(y, x), nb - 1)] == x).sum())
        return 100 * both >= percent * (na + nb - both)

    def run(batches):
        for b in batches:
            na, nb = b.column(4).to_pylist(), b.column(5).to_pylist()
            ok = [test(i, j, x.as_buffer(), y.as_buffer()) for i, j, x, y in zip(na, nb, b.column(6), b.column(7), strict=True)]
            yield b.select(["a", "b", "ha", "hb"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Texts:
    """The sets of some classes, worked out again from the texts that have them."""

    def __init__(self, docs: DataFrame, rows: DataFrame, words: int, percent: int):
        self.docs, self.rows, self.words, self.percent = docs, rows, words, percent

    def of(self, wanted: DataFrame, whole: bool) -> DataFrame:
        """h1, h2, n and hashes or sketch of the classes with the hashes h1 of `wanted`, a row each. One text is read of each class."""
        ids = durable(self.rows.join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "jaccard-ids")
        some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        kind = "hashes binary" if whole else "sketch array<long>"
        found = self.docs.join(some, self.docs["doc_id"].eqNullSafe(some["doc_id"]), "left_semi").mapInArrow(giving_back(_content(self.words, whole)), f"h1 long, h2 long, n long, {kind}")
        return durable(found.join(wanted, "h1", "left_semi").dropDuplicates(["h1", "h2"]), "jaccard-sets")

    def links(self, pairs: DataFrame, near: bool) -> DataFrame:
        """The links among the pairs (a, b: class hashes h1), as pairs of (h1, h2): one hash of 64 bits doesn't tell 10 ** 10 texts apart.

        near: their dense sketches have allowed it already.
        """
        wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
        if not near:
            x, y = self._ends(self.of(wanted, False), "sketch")
            both = pairs.join(x, "a").join(y, "b")
            longer, shorter = F.size("x") > F.size("y"), F.size("y") > F.size("x")
            pairs = durable(both.where(distance(F.when(longer, folded(F.col("x"))).otherwise(F.col("x")), F.when(shorter, folded(F.col("y"))).otherwise(F.col("y"))) <= most_apart(F.col("na"), F.col("nb"), self.percent)).select("a", "b").distinct(), "jaccard-near")
            wanted = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
        x, y = self._ends(self.of(wanted, True), "hashes")
        found = pairs.join(x, "a").join(y, "b").select("a", "b", "ha", "hb", "na", "nb", "x", "y").mapInArrow(giving_back(_linked(self.percent)), "a long, b long, ha long, hb long")
        return durable(found.select(_class("a", "ha").alias("a"), _class("b", "hb").alias("b")).distinct(), "jaccard-links")

    @staticmethod
    def _ends(sets: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        return tuple(sets.select(F.col("h1").alias(e), F.col("h2").alias(f"h{e}"), F.col("n").alias(f"n{e}"), F.col(column).alias(x)) for e, x in (("a", "x"), ("b", "y")))


def _class(h1: str, h2) -> Column:
    return F.struct(F.col(h1).alias("h1"), (F.col(h2) if isinstance(h2, str) else h2).alias("h2"))


def most_apart(na: Column, nb: Column, percent: int) -> Column:
    """The most shingles in which linked sets of na and nb differ."""
    return F.floor((na + nb) * (100 - percent) / (100 + percent))


def _meeting(placed: DataFrame) -> DataFrame:
    """placed (key, c, n, own, pop, k) with out, m (its key's rows), p and q, without the keys that are done.

    out: the set isn't in the component of its key's most popular one, with which all of the key have been compared. Keys
    without such sets, or with two sets, are done.
    """
    top = placed.groupBy("key").agg(F.max(F.struct("pop", "c", "k")).getField("k").alias("hk"), F.count(F.lit(1)).alias("m")).where(F.col("m") > 2)
    marked = placed.join(top, "key").withColumn("out", F.col("k") != F.col("hk")).drop("pop", "hk")
    sizes = marked.groupBy("key").agg(F.count_if("out").alias("o"), F.first("m").alias("m")).where(F.col("o") > 0)
    sizes = sizes.select("key", F.ceil(F.col("o") / MEET).alias("p"), F.ceil(F.col("m") / MEET).alias("q"))
    return durable(marked.join(sizes, "key"), "jaccard-marked")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of the _meeting() rows of one key that may link, a row for each key: every outsider meets every row of its key once.

    Outsiders are dealt to p blocks and go to all q blocks of the others, these the other way round, so a task has MEET
    times MEET rows on average. With a column `sketch`, pairs that are too far apart by it are left out.
    """
    sketched = "sketch" in rows.columns

    def blocks(count: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    def side(of: DataFrame, i: Column, j: Column, c: str, *more: str) -> DataFrame:
        return of.select("key", i.alias("i"), j.alias("j"), F.col("c").alias(c), *(F.col(x).alias(x + c) for x in ("n", "k", "own", *more)))

    i, j = F.pmod(F.xxhash64("c"), F.col("p")), F.pmod(F.xxhash64(F.lit(1), "c"), F.col("q"))
    more = ("sketch",) if sketched else ()
    x, y = side(rows.where("out"), i, F.explode(blocks("q")), "a", *more), side(rows, F.explode(blocks("p")), j, "b", "out", *more)
    allowed = (~F.col("outb") | (F.col("a") < F.col("b"))) & (F.col("ka") != F.col("kb")) & _may("na", "nb", "owna", "ownb", percent)
    if sketched:
        allowed &= distance(F.col("sketcha"), F.col("sketchb")) <= most_apart(F.col("na"), F.col("nb"), percent)
    return x.join(y, ["key", "i", "j"]).where(allowed).select("a", "b", "na", "nb")


def _may(na: str, nb: str, one: str, other: str, percent: int) -> Column:
    """Sizes allow a link, and the layout is the one of the smaller set's band, so that a pair meets in one layout."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.col(one) | F.col(other))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document.

    docs: doc_id and text among any other columns. Two documents link when 100 * shared >= percent * all of their
    distinct shingles; component_id is the smallest doc_id that links reach, itself included. Null texts and texts
    without words have no shingles and no links. Links go from text to text, also where rows
    share a doc_id; rows without one get the component of an equal text, or null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(plain.mapInArrow(giving_back(_counted(words, percent)), "doc_id long, n long, h1 long, h2 long, keys array<long>, counts array<long>"), "jaccard-rows")
    often = rows.where(F.size("keys") > 0).select(F.explode(F.arrays_zip("keys", "counts")).alias("k")).groupBy("k.keys").agg(F.sum("k.counts").alias("n"))
    often = often.orderBy(F.desc("n"), "keys").limit(MOST_FREQUENT).toPandas()  # at most MOST_FREQUENT numbers
    found = often["keys"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    late = spark.sparkContext.broadcast((found[order], len(found) - order))  # the most frequent has the last place
    deal = F.when(F.col("kind") == _MORE, F.xxhash64("key", "c")).otherwise(F.col("key"))  # only hubs must meet
    hubs = plain.mapInArrow(giving_back(_emitting(words, percent, late)), KEYED).repartition(partitions(spark), deal).sortWithinPartitions("key", "c")
    members = durable(hubs.mapInArrow(giving_back(_repeated), "key long, c long, n int, own boolean").distinct(), "jaccard-members")
    rows = rows.select("doc_id", "n", "h1", "h2")
    texts = _Texts(plain, rows, words, percent)

    popular = members.join(members.groupBy("c").agg(F.count(F.lit(1)).alias("pop")), "c")
    popular = durable(popular.select("key", "c", "n", "own", "pop"), "jaccard-popular")
    hub = popular.groupBy("key").agg(F.max(F.struct("pop", "c", "n", "own")).alias("h")).select("key", F.col("h.c").alias("hc"), F.col("h.n").alias("hn"), F.col("h.own").alias("ho"))
    met = popular.join(hub, "key").where((F.col("c") != F.col("hc")) & _may("n", "hn", "own", "ho", percent))
    tried = durable(met.select(F.least("c", "hc").alias("a"), F.greatest("c", "hc").alias("b")).distinct(), "jaccard-pairs")
    links = texts.links(tried, near=False)

    known = components(links).select(F.col("node.h1").alias("c"), "component")
    placed = popular.join(known, "c", "left").select("key", "c", "n", "own", "pop", F.coalesce("component", _class("c", F.lit(0).cast("long"))).alias("k"))
    rows_met = _meeting(durable(placed, "jaccard-placed"))
    many = rows_met.where(F.col("m") > FEW)
    sketches = texts.of(many.select(F.col("c").alias("h1")).distinct(), False).select(F.col("h1").alias("c"), "sketch")
    sketched = many.join(sketches, "c").withColumn("sketch", F.when(F.col("own"), F.col("sketch")).otherwise(folded(F.col("sketch"))))
    met = _met(rows_met.where(F.col("m") <= FEW), percent).unionByName(_met(sketched, percent))
    common = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.count(F.lit(1)).alias("common"))

    def most(n):
        return F.floor((n + F.floor(100 * n / percent)) * (100 - percent) / (100 + percent))

    least = F.least(most(F.col("na")), most(F.col("nb"))) + 1 - most_apart(F.col("na"), F.col("nb"), percent)
    pairs = durable(common.where(F.col("common") >= least).select("a", "b").join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    links = links.unionByName(texts.links(pairs, near=True))
    classes = durable(rows.where(F.col("n") > 0).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    joined = components(links).select("node.h1", "node.h2", "component")
    of_class = classes.join(joined, ["h1", "h2"], "left").select("h1", "h2", "rep", F.coalesce("component", _class("h1", "h2")).alias("k"))
    of_class = durable(of_class, "jaccard-components")
    first = of_class.groupBy("k").agg(F.min("rep").alias("component_id"))
    placed = of_class.join(first, "k").select("h1", "h2", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2").join(placed, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of docs: of each component the rows with its smallest doc_id, and all rows without a doc_id."""
    found = near_duplicates(docs, words, percent)
    gone = durable(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct(), "jaccard-gone")
    rows = packed(docs, "doc_id")
    return rows.join(gone, rows["doc_id"] == F.col("_gone"), "left_anti").select(*unpacked(docs.columns))
