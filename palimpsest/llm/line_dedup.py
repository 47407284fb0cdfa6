"""Line dedup by distinct-site spread: lines on many sites are boilerplate and go from all documents but the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import durable, packed, unpacked

#: A line on so many sites is boilerplate.
SITES = 5
#: Log2 of the sketch's registers; its standard error is about 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 9
#: So many standard errors, and one site, around SITES count as near the threshold.
ERRORS = 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits: two hashes of a line without its outer blanks."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """k1, k2, first (smallest doc_id) of the lines on at least `sites` distinct sites.

    lines: doc_id, site, k1, k2. A HyperLogLog sketch of sites a line merges by aggregation; lines estimated near the
    threshold are counted exactly, so the result is that of an exact count unless an estimate is off by more than
    ERRORS standard errors.
    """
    margin = ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2) * sites + 1
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("spread"), F.min("doc_id").alias("first"))
    spread = durable(spread.where(F.col("spread") >= sites - margin), "line-spread")
    near = spread.where(F.col("spread") < sites + margin)
    counted = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2", "site").agg(F.lit(1).alias("n"))
    sure = counted.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= sites).join(near, ["k1", "k2"])
    return spread.where(F.col("spread") >= sites + margin).select("k1", "k2", "first").unionByName(sure.select("k1", "k2", "first"))


def _cleaned(docs: DataFrame, sites: int) -> DataFrame:
    """docs, packed, with the working columns clean, n_lines and n_removed."""
    rows = packed(docs, "doc_id", "text", "source")
    each = rows.select("doc_id", F.xxhash64(F.col("source").isNull(), F.col("source").cast("string")).alias("site"), F.explode(_lines(F.col("text"))).alias("line")).where(F.trim("line") != "")
    lines = durable(each.select("doc_id", "site", _key(F.col("line")).alias("k")).select("doc_id", "site", "k.k1", "k.k2").distinct(), "lines")
    gone = lines.join(boilerplate(lines, sites), ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    by_doc = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("k1", "k2")).alias("_gone"))
    joined = rows.join(by_doc, rows["doc_id"].eqNullSafe(F.col("_doc")), "left")
    kept = F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_gone"), _key(x)))
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))).withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    out = out.withColumn("n_removed", F.when(F.col("_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("_kept")))
    return out.withColumn("clean", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.concat_ws("\n", "_kept")))


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, source, text (cleaned), n_lines, n_removed: one row a document.

    docs: doc_id, text and source (the site) among any other columns. A line is what stands between line ends; outer
    spaces don't tell lines apart, and blank lines are never boilerplate. Boilerplate stays in the document with the
    smallest doc_id that has it (in all rows of that doc_id) and goes from the others. A null site is a site of its
    own. A null text stays null with 0 lines; an empty table gives no rows.
    """
    return _cleaned(docs, sites).select("doc_id", F.col("_row.source").alias("source"), F.col("clean").alias("text"), "n_lines", "n_removed")


def cleaned_documents(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The columns of docs with cleaned texts, without the documents of which nothing is left; n_chars follows the text."""
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("clean", "\n\t\r", "")) == "")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        own = F.col("_row").getField("n_chars")
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("clean")).otherwise(own).cast(docs.schema["n_chars"].dataType)
    return _cleaned(docs, sites).where(~F.coalesce(emptied, F.lit(False))).select(*unpacked(docs.columns, **changed))
