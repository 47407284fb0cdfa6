"""Mixing sources to target weights: repetition rates by source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import durable, packed, partitions, unpacked, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Up to so many sources are broadcast; more are joined by a shuffle whose hot partitions Spark splits.
BROADCAST_SOURCES = 50_000


def source_sizes(sized: DataFrame) -> DataFrame:
    """source, source_size, number: sources by code point, null last, numbered from 0 without one task for all."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sizes.repartitionByRange(partitions(sized.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    ranged = durable(ranged, "sources")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - F.lit(1)
    return durable(ranged.withColumn("number", local).join(starts, "_part").select("source", "source_size", (F.col("number") + F.col("first")).alias("number")), "source-numbers")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add `target`: share of all sizes dealt by weight, none above `most` times its source's size.

    What a capped source leaves is dealt to the others by weight until none is above its cap; each round is one
    aggregate over the sources, and only two sums come to the driver.
    """
    table = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.withColumn("_weight", F.element_at(table, (F.col("number") % len(weights) + 1).cast("int"))).withColumn("_cap", most * F.col("source_size"))
    total = (weighed.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") <= level * F.col("_weight")
        row = weighed.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("weight")
        ).first()
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (total - row["taken"]) / row["weight"]
    return weighed.withColumn("target", F.least("_cap", level * F.col("_weight"))).drop("_weight", "_cap")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target and copies.

    Size: words of the text, 0 for null. The rate of a source is target / size; a document is taken floor(rate) times
    and once more with the fraction as probability, by a hash of its doc_id, so reruns agree and rows that share a
    doc_id are drawn alike, as are all without one. A source without words gets no copies. An empty table gives no rows.
    docs may not have columns of the names that are added.
    """
    if clash := {"size", "source_size", "target", "copies"} & set(docs.columns):
        raise ValueError(f"docs has {', '.join(sorted(clash))} already")
    sized = docs.withColumn("size", word_count(F.col("text")))
    sources = targets(source_sizes(sized.select("source", "size"))).select(F.col("source").alias("_source"), "source_size", "target")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    joined = sized.join(sources, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < rate - whole).cast("int")).cast("int"))


def mixed_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row a document."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return mix(plain, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken."""
    taken = mix(packed(docs, "doc_id", "text", "source"), seed).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).select(*unpacked(docs.columns))
