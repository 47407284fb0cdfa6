"""Log template mining: masked lines in buckets of length and leading tokens, merged by similarity in arrival order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import masked

#: Fixed values of the method.
DEPTH, SIMILAR, MOST_CLUSTERS, ANY = 4, 0.5, 64, "<*>"


def fold(lines: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one bucket from distinct lines with their counts, in the order of first arrival.

    A line that came before changes no cluster when it comes again: the cluster that took it matches it in every word
    that isn't ANY, and widening keeps that so. Its later arrivals only add to a count, and as a cluster that fits
    better may have begun meanwhile, all of them go where the first went.
    """
    clusters: list[list] = []  # [tokens, count, first]
    for text, n, first in lines.sort_values("first").itertuples(index=False):
        words = text.split(" ")
        scored = [sum(a in (b, ANY) for a, b in zip(c[0], words, strict=True)) / len(words) for c in clusters]
        at = max(range(len(scored)), key=scored.__getitem__, default=None)
        if at is None or scored[at] <= SIMILAR:
            if len(clusters) < MOST_CLUSTERS:
                clusters.append([words, n, first])
                continue
            at = len(clusters) - 1  # a full bucket widens its last cluster
        c = clusters[at]
        c[0] = [a if a == b else ANY for a, b in zip(c[0], words, strict=True)]
        c[1] += n
        c[2] = min(c[2], first)
    return pd.DataFrame([(" ".join(t), n, first) for t, n, first in clusters], columns=["template", "n", "first"])


def templates(lines: DataFrame, text: str, order: str) -> DataFrame:
    """template, n, first. Equal masked lines are counted before any Python sees them, so a task gets distinct lines alone."""
    counted = lines.select(masked(F.col(text)).alias("line"), F.col(order).alias("o")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"))
    words = F.split("line", " ")
    keyed = counted.withColumn("size", F.size(words)).withColumn("prefix", F.array_join(F.slice(words, 1, DEPTH), " "))
    own = keyed.groupBy("size", "prefix").applyInPandas(lambda b: fold(b[["line", "n", "first"]]), "template string, n long, first long")
    return own.groupBy("template").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
