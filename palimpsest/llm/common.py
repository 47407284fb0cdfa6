"""What the corpus operators share: the shared folder, durable cuts, word rules, ordered numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.storage import shared_path

#: What stands between words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a class for Java's and DuckDB's patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and fixes what
    depends on the order in which a shuffle delivered its rows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """_row (all columns of docs as one struct) and the named columns: extra columns can't clash with working ones."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *columns)


def unpacked(names: list[str], **changed: Column) -> list[Column]:
    """The columns of a packed _row again, some of them changed."""
    return [(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in names]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable, not a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.size(word_array(text)).cast("long")


def ranges(ids: DataFrame, column: str, pieces: int) -> list[int]:
    """At most `pieces` - 1 ascending cut values that split a long column into about equal ranges.

    The cuts come from percentile_approx, whose summary has a fixed size; they number no more than the
    shuffle partitions do, so they are small at any size.
    """
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = ids.agg(F.percentile_approx(column, shares, 20 * pieces).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below value: a binary search inside one expression. Null goes to range 0."""
    if not cuts:
        return F.lit(0)
    bits = len(cuts).bit_length()
    table = F.lit(cuts).cast("array<long>")
    steps = F.lit([1 << b for b in reversed(range(bits))]).cast("array<int>")
    n = F.lit(len(cuts))

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= n) & (F.get(table, to - F.lit(1)) <= value), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def numbered(df: DataFrame, within: str, part: str, order: list, out: str, name: str) -> DataFrame:
    """df with a gapless number from 0 in each value of `within`, without one task for each value.

    Rows are numbered in their (within, part) group, `part` being a fixed column that spreads every value of
    `within`; a running sum of the group sizes, one row for each group, gives the first number of each group.
    """
    local = durable(df.withColumn(out, F.row_number().over(Window.partitionBy(within, part).orderBy(*order)) - F.lit(1)), name)
    sizes = local.groupBy(within, part).agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(within).alias("_w"), F.col(part).alias("_p"), first.alias("_first"))
    joined = local.join(starts, local[within].eqNullSafe(F.col("_w")) & local[part].eqNullSafe(F.col("_p")))
    return joined.withColumn(out, (F.col(out) + F.col("_first")).cast("long")).drop("_w", "_p", "_first")
