"""Knowledge retrieval: section versions, BM25, cosine, rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import tokens
from palimpsest.storage import cut

#: Fixed values of the scores.
K1, B, RRF, DEPTH, BOOST = 1.2, 0.75, 60, 50, 1.5
#: Vectors in a shard and queries in a block of a search.
SHARD, BLOCK = 16_384, 4_096


def _r(x: Column) -> Column:
    return F.round(x, 6)


def _times(word: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == word))


def bm25(sections: DataFrame, query: list[str], id_: str, text: str) -> DataFrame:
    """id, score of the sections that share a term with the query; every step rounds to six decimals, terms in query order."""
    terms = list(dict.fromkeys(query))
    own = sections.select(F.col(id_), tokens(F.col(text)).alias("_t"))
    counted = cut(own.select(id_, F.size("_t").alias("_n"), *(_times(w).alias(f"_f{i}") for i, w in enumerate(terms))), "bm25")  # so that texts are read and split once
    stats = counted.agg(F.count(F.lit(1)).alias("_all"), _r(F.avg("_n")).alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))))
    joined = counted.join(F.broadcast(stats))  # one row
    length = _r(K1 * _r(F.lit(1 - B) + _r(B * _r(F.col("_n") / F.when(F.col("_avg") == 0, 1.0).otherwise(F.col("_avg"))))))
    parts = []
    for i in range(len(terms)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = _r(F.log(_r(1 + _r(_r(F.col("_all") - d + 0.5) / _r(d + 0.5)))))
        parts.append(F.when(f > 0, _r(idf * _r(_r(f * (K1 + 1)) / _r(f + length)))))
    score = F.aggregate(F.array(*parts), F.lit(0.0), lambda sum_, part: F.when(part.isNull(), sum_).otherwise(_r(sum_ + part)))
    return joined.select(id_, score.alias("score")).where("score > 0")


def _comparable(vectors: DataFrame, id_: str) -> DataFrame:
    """id, embedding, _dims of the vectors that have a direction: finite components, not all zero."""
    own = vectors.select(F.col("vec_id").cast("long").alias(id_), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("_dims"))
    return own.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))


def _nearest(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            x, q = (np.stack(t["embedding"].to_numpy()) for t in (vectors, queries))
            x, q = (y / np.abs(y).max(axis=1, keepdims=True) for y in (x, q))
            x, q = (y / np.sqrt((y * y).sum(axis=1, keepdims=True)) for y in (x, q))
            ids, own = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            for at in range(0, len(q), 256):  # so that the products stay small
                for query, score in zip(own[at : at + 256], np.round(q[at : at + 256] @ x.T, 6) + 0.0, strict=True):
                    if len(score) > k + 1:
                        near = np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1])
                    else:
                        near = np.arange(len(score))
                    near = near[ids[near] != query]
                    near = near[np.lexsort((ids[near], -score[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near], "score": score[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    return run


def cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine of every query with every vector of its length but itself, rounded to six
    decimals, ties to the smaller vec_id. Ids are unique. Any number of queries: blocks of them meet shards of the vectors."""
    own, asked = _comparable(vectors, "vec_id"), _comparable(queries, "query_id")
    shards, blocks = max(1, -(-own.count() // SHARD)), max(1, -(-asked.count() // BLOCK))
    dealt = own.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asking = asked.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    scored = dealt.groupBy("_dims", "_shard", "_block").cogroup(asking.groupBy("_dims", "_shard", "_block")).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a shard
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], id_: str, in_scope: Column) -> DataFrame:
    """id, score, rank: reciprocal ranks of several rankings (id, rank) summed to DEPTH; what is in scope counts BOOST times."""
    every = None
    for ranking in rankings:
        own = ranking.where(F.col("rank") <= DEPTH).select(id_, (1.0 / (RRF + F.col("rank"))).alias("_s"))
        every = own if every is None else every.unionByName(own)
    total = every.groupBy(id_).agg(F.sum("_s").alias("_s")).withColumn("score", F.round(F.col("_s") * F.when(in_scope, BOOST).otherwise(1.0), 6)).drop("_s")
    return total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))  # at most DEPTH rows a ranking


def section_versions(history: DataFrame) -> DataFrame:
    """Versions of sections from puts (document, put, digest): equal neighbours are one, the next put that differs ends it."""
    w = Window.partitionBy("document").orderBy("put")
    new = history.withColumn("_old", F.lag("digest").over(w)).where(~F.col("digest").eqNullSafe(F.col("_old")))
    return new.withColumn("known_to", F.lead("put").over(w)).select("document", "digest", F.col("put").alias("known_from"), "known_to")


def pending(sections: DataFrame, embedded: DataFrame, digest: str) -> DataFrame:
    """Digests without an embedding, each with its smallest section."""
    return sections.join(embedded.select(digest), digest, "left_anti").groupBy(digest).agg(F.min("section").alias("section"))


def documents_as_of(links: DataFrame, scope: DataFrame, aliases: DataFrame, valid: Column, observed: Column) -> DataFrame:
    """document, via of the documents linked at a valid instant, as known at another, to an entity of the scope or to one that shares a catalog entry with it.

    links: document, entity, valid_from, valid_to, known_from; scope: entity; aliases: entry, entity.
    """
    entries = aliases.join(scope.select("entity"), "entity", "left_semi").select("entry").distinct()
    wider = aliases.join(entries, "entry", "left_semi").select("entity").unionByName(scope.select("entity")).distinct()
    live = (F.col("valid_from") <= valid) & (F.col("valid_to").isNull() | (valid < F.col("valid_to"))) & (F.col("known_from") <= observed)
    return links.where(live).join(wider, "entity").groupBy("document").agg(F.min("entity").alias("via"))


def sections_as_of(versions: DataFrame, observed: Column) -> DataFrame:
    """The sections known at an instant. versions: known_from, known_to."""
    return versions.where((F.col("known_from") <= observed) & (F.col("known_to").isNull() | (observed < F.col("known_to"))))


def lexical_text(stored: DataFrame, made: DataFrame) -> DataFrame:
    """section, text to rank by words: the stored section's label and text, and where a document has none stored the one made from its summary.

    stored: document, section, label, text; made: document, text.
    """
    own = stored.select("document", "section", F.concat_ws(" ", "label", "text").alias("text"))
    rest = made.join(stored.select("document").distinct(), "document", "left_anti").select("document", F.concat(F.col("document").cast("string"), F.lit("#made")).alias("section"), "text")
    return own.unionByName(rest)


def fuse_documents(rankings: list[DataFrame], scope: DataFrame, k: int) -> DataFrame:
    """document, section, score, rank of the k best documents: reciprocal ranks of sections (document, section, rank) summed, DEPTH each, BOOST times for documents in scope; a document stands for its best section, ties by section."""
    every = None
    for ranking in rankings:
        own = ranking.where(F.col("rank") <= DEPTH).select("document", "section", (1.0 / (RRF + F.col("rank"))).alias("_s"))
        every = own if every is None else every.unionByName(own)
    boosted = every.groupBy("document", "section").agg(F.sum("_s").alias("_s")).join(scope.select("document").distinct().withColumn("_in", F.lit(True)), "document", "left")
    scored = boosted.withColumn("score", F.round(F.col("_s") * F.when(F.col("_in"), BOOST).otherwise(1.0), 6))
    best = scored.groupBy("document").agg(F.min(F.struct((-F.col("score")).alias("key"), "section")).alias("b")).select("document", "b.section", (-F.col("b.key")).alias("score"))
    return best.orderBy(F.desc("score"), "document").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document")))  # k rows


def with_unmatched(found: DataFrame, scope: DataFrame, most: int) -> DataFrame:
    """What a search found, then the documents in scope that it didn't match, by name, up to `most` of these: document, rank, matched."""
    rest = scope.select("document").distinct().join(found.select("document"), "document", "left_anti").orderBy("document").limit(most)
    after = rest.withColumn("rank", F.row_number().over(Window.orderBy("document")))  # `most` rows
    last = found.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_last"))  # one row
    tail = after.join(F.broadcast(last)).select("document", (F.col("rank") + F.col("_last")).alias("rank"), F.lit(False).alias("matched"))
    return found.select("document", "rank", F.lit(True).alias("matched")).unionByName(tail)
