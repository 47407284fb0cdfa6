"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

Every distinct shingle hash below a fixed fraction of the hash range is kept, so a sketch grows with its document, the
sketch of a union is the union of sketches, and |A and B| / |A| on sketches estimates containment however unequal the
two are. A text whose hashes are all above the threshold has an empty sketch, which says nothing: it is like no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import let, partitions, range_of, ranges, word_array

WORDS = 5
#: One of so many hashes is kept.
SCALE = 8
#: Rows in a range of doc_id, on average, and the most ranges.
ROWS, RANGES = 50_000, 20_000


def _shingles(words: Column) -> Column:
    """63-bit hashes of all runs of WORDS words; of all words together if there are fewer; none for none."""

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - F.lit(WORDS)), lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + F.lit(k)) for k in range(WORDS))), 1))
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        return F.when(n >= WORDS, runs).when(n > 0, short).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Ascending distinct shingle hashes below 2**63 / scale; none for a text without words."""
    low = F.filter(_shingles(word_array(F.lower(text))), lambda h: h < F.lit((1 << 63) // scale))
    return F.array_sort(F.array_distinct(low))


def fingerprint(of: Column) -> Column:
    """A sketch as text: each hash as 16 hex digits."""
    return F.array_join(F.transform(of, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketched texts, 0 to 1; 0 if either sketch is empty, as nothing in common was seen."""
    total = F.size(a) + F.size(b) - shared(a, b)
    return F.when(total == 0, 0.0).otherwise(shared(a, b) / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a has none."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame, pieces: int) -> DataFrame:
    """docs (doc_id and others) with `next`, the struct of the following row by doc_id; after the last comes the first.

    Rows go to ranges of doc_id, and the first row of each range also to the range before it (of the first range, to
    the last), so no task sees more than a range and its successor. Rows that share a doc_id follow each other by hash.
    """
    names = docs.columns
    ids = docs.select("doc_id")
    cuts = ranges(ids, "doc_id", pieces)
    own = range_of(F.col("doc_id"), cuts)
    firsts = ids.select("doc_id", own.alias("b")).groupBy("b").agg(F.min("doc_id").alias("first")).orderBy("b").collect()  # a row a range
    if not firsts:
        return docs.withColumn("next", F.struct(*names))
    first, before = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, r in enumerate(firsts):
        first[r["b"]], before[r["b"]] = r["first"], firsts[i - 1]["b"]
    head = firsts[0]["first"]
    firsts_of, before_of = F.array(*(F.lit(x).cast("long") for x in first)), F.array(*(F.lit(x) for x in before))

    def place(b: Column, guest: Column) -> Column:
        return F.struct(b.cast("int").alias("b"), guest.alias("guest"))

    row = F.struct(*names)
    here = place(own, F.lit(0))
    there = place(F.get(before_of, own), F.when(F.col("doc_id") == F.lit(head), 2).otherwise(1))
    dealt = docs.select(row.alias("row"), F.xxhash64(*(c for c in names if c != "doc_id")).alias("tie"), F.explode(F.when(F.col("doc_id") == F.get(firsts_of, own), F.array(here, there)).otherwise(F.array(here))).alias("at"))
    # A guest is of a later range, so it sorts after the range's own rows; one that wraps around sorts last of all.
    order = Window.partitionBy("at.b").orderBy(F.col("at.guest") > 0, "row.doc_id", "tie")
    return dealt.withColumn("next", F.lead("row").over(order)).where(F.col("at.guest") == 0).select("row.*", "next")


def compare_with_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the containments of the
    text in the edited one and in the next: one row a document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document by doc_id. docs: doc_id and text among any other columns. A null text is an empty one; rows without a
    doc_id come as if theirs was below -2**62, by a hash of their text; a single document follows itself; an empty table
    gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce("id", F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64("text"), 2))
    pieces = min(RANGES, max(partitions(docs.sparkSession), -(-docs.count() // ROWS)))
    rows = with_next(own.select(place.alias("doc_id"), "id", "text", sketch(F.col("text"), scale).alias("sketch")), pieces)
    rows = rows.select(F.col("id").alias("doc_id"), "text", "sketch", "next", F.char_length("text").cast("int").alias("n"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", "n", "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = rows.select("doc_id", "n", "sketch", "next_sketch", F.sha2("edited", 256).alias("sha"), sketch(F.col("edited"), scale).alias("edited_sketch"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), containment(a, b).alias("contained_edited"), containment(a, c).alias("contained_next"),
    )
