"""Retrieval queries over documents and embeddings."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import tokens
from palimpsest.operators import knowledge as op
from palimpsest.registry import query
from palimpsest.sources import model as m
from palimpsest.sources.model import table

_WORDS = ["eaten", "the", "anand", "loser"]
_TOK = r"k AS (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS t FROM documents)"


def _bm25_sql() -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_WORDS))
    frequent = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(_WORDS)))
    length = "round(1.2::DOUBLE * round(0.25::DOUBLE + round(0.75::DOUBLE * round(n / a, 6), 6), 6), 6)"
    score = "0.0::DOUBLE"
    for i in range(len(_WORDS)):
        idf = f"round(ln(round(1 + round(round(al - d{i} + 0.5::DOUBLE, 6) / round(d{i} + 0.5::DOUBLE, 6), 6), 6)), 6)"
        score = f"CASE WHEN f{i} > 0 THEN round({score} + round({idf} * round(round(f{i} * 2.2::DOUBLE, 6) / round(f{i} + {length}, 6), 6), 6), 6) ELSE {score} END"
    return f"{_TOK}, c AS (SELECT doc_id, source, len(t) AS n, {counts} FROM k), s AS (SELECT count(*) AS al, round(avg(n), 6) AS a, {frequent} FROM c), b AS (SELECT doc_id, source, {score} AS score FROM c CROSS JOIN s)"


@query(f"WITH {_bm25_sql()} SELECT doc_id, score FROM b WHERE score > 0")
def bm25(spark, sf_dir):
    return op.bm25(table(spark, sf_dir, "documents"), _WORDS, "doc_id", "text")


@query(f"WITH {_TOK} SELECT doc_id, len(list_intersect(t, ['loser', 'trash', 'moron'])) AS hits FROM k WHERE len(list_intersect(t, ['loser', 'trash', 'moron'])) > 0")
def lexical_prefilter(spark, sf_dir):
    hits = F.size(F.array_intersect(tokens(F.col("text")), F.array(F.lit("loser"), F.lit("trash"), F.lit("moron"))))
    return table(spark, sf_dir, "documents").select("doc_id", hits.cast("long").alias("hits")).where("hits > 0")


_COS = "s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id < 5 AND v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"
_COS_ALL = _COS.replace("q.vec_id < 5", "q.vec_id % 20 = 0")


@query(f"WITH {_COS_ALL} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op.cosine(v, v.where("vec_id % 20 = 0"), 10)


@query(
    f"""WITH {_COS}, x AS (SELECT vec_id AS id, rank FROM r WHERE query_id = 0 AND rank <= 50), y AS (SELECT vec_id AS id, rank FROM r WHERE query_id = 1 AND rank <= 50),
    u AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM x UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM y), f AS (SELECT id, round(sum(s) * CASE WHEN id % 4 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM u GROUP BY id)
    SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f"""
)
def rrf(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ranked = op.cosine(v, v.where("vec_id < 2"), 50).select("query_id", F.col("vec_id").alias("id"), "rank")
    return op.fuse([ranked.where("query_id = 0"), ranked.where("query_id = 1")], "id", F.col("id") % 4 == 0)


_PUTS = "h AS (SELECT conv_id AS document, turn AS put, sha256(role || CASE WHEN turn % 3 = 0 THEN 'x' ELSE '' END) AS digest FROM conversations)"


def _puts(spark, sf_dir):
    digest = F.sha2(F.concat("role", F.when(F.col("turn") % 3 == 0, "x").otherwise("")), 256)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("put"), digest.alias("digest"))


@query(f"WITH {_PUTS}, n AS (SELECT *, lag(digest) OVER w AS old FROM h WINDOW w AS (PARTITION BY document ORDER BY put)), k AS (SELECT * FROM n WHERE digest IS DISTINCT FROM old) SELECT document, digest, put AS known_from, lead(put) OVER (PARTITION BY document ORDER BY put) AS known_to FROM k")
def sections_scd2(spark, sf_dir):
    return op.section_versions(_puts(spark, sf_dir))


@query("SELECT sha256(text) AS digest, min(doc_id) AS section FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def pending_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), F.sha2("text", 256).alias("digest"))
    return op.pending(d, d.where("section % 3 = 0"), "digest")


@query(
    f"""WITH {m.V}, l AS (SELECT event_id % 500 AS document, entity, valid_from AS f, valid_to AS t, observed_from AS o FROM v), s AS (SELECT entity FROM (SELECT DISTINCT entity, user_id FROM a) x WHERE user_id % 10 = 3), c AS (SELECT DISTINCT 'n' || (user_id % 25) AS entry, entity FROM a WHERE user_id % 2 = 1),
    w AS (SELECT entity FROM s UNION SELECT entity FROM c WHERE entry IN (SELECT entry FROM c WHERE entity IN (SELECT entity FROM s)))
    SELECT document, min(entity) AS via FROM l WHERE entity IN (SELECT entity FROM w) AND f <= TIMESTAMP '{m.T1}' AND (t IS NULL OR TIMESTAMP '{m.T1}' < t) AND o <= TIMESTAMP '{m.KNOWN}' GROUP BY 1"""
)
def documents_in_scope(spark, sf_dir):
    """Documents linked, as of two instants, to entities of a scope or to ones that share a catalog entry with them."""
    v, a = m.versions(spark, sf_dir), m.assertions(spark, sf_dir)
    links = v.select((F.col("event_id") % 500).alias("document"), "entity", "valid_from", "valid_to", F.col("observed_from").alias("known_from"))
    scope = a.where("user_id % 10 = 3").select("entity").distinct()
    aliases = a.where("user_id % 2 = 1").select(F.concat(F.lit("n"), F.col("user_id") % 25).alias("entry"), "entity").distinct()
    return op.documents_as_of(links, scope, aliases, m.at(m.T1), m.at(m.KNOWN))


_RANKED = """x AS (SELECT doc_id % 120 AS document, doc_id AS section, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), y AS (SELECT doc_id % 120 AS document, doc_id AS section, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents),
 u AS (SELECT * FROM x WHERE r <= 50 UNION ALL SELECT * FROM y WHERE r <= 50), s AS (SELECT document, section, round(sum(1.0::DOUBLE / (60 + r)) * CASE WHEN document % 4 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM u GROUP BY document, section),
 b AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, section) AS n FROM s), t AS (SELECT document, section, score, row_number() OVER (ORDER BY score DESC, document) AS rank FROM b WHERE n = 1 ORDER BY score DESC, document LIMIT 10)"""


def _fused(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 120).alias("document"), F.col("doc_id").alias("section"), "n_chars")
    best = lambda order: d.orderBy(order, "section").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(order, "section")))
    scope = d.where("document % 4 = 0").select("document").distinct()
    return op.fuse_documents([best(F.desc("n_chars")), best(F.asc("n_chars"))], scope, 10), scope


@query(f"WITH {_RANKED} SELECT * FROM t")
def search_fusion(spark, sf_dir):
    """Two rankings of sections fused into documents, each by its best section."""
    return _fused(spark, sf_dir)[0]


@query(f"WITH {_RANKED}, q AS (SELECT DISTINCT doc_id % 120 AS document FROM documents WHERE (doc_id % 120) % 4 = 0 AND doc_id % 120 NOT IN (SELECT document FROM t)) SELECT document, rank, true AS matched FROM t UNION ALL SELECT document, (SELECT max(rank) FROM t) + row_number() OVER (ORDER BY document), false FROM (SELECT * FROM q ORDER BY document LIMIT 5) z")
def search_unmatched_tail(spark, sf_dir):
    """What was found, then documents in scope that weren't matched."""
    return op.with_unmatched(*_fused(spark, sf_dir), 5)


@query("WITH s AS (SELECT doc_id % 300 AS document, CAST(doc_id AS VARCHAR) AS section, source || ' ' || lang AS text FROM documents WHERE doc_id % 300 < 100), m AS (SELECT DISTINCT doc_id % 300 AS document FROM documents) SELECT * FROM s UNION ALL SELECT document, document || '#made', 'summary ' || document FROM m WHERE document NOT IN (SELECT document FROM s)")
def lexical_texts(spark, sf_dir):
    """Stored sections, and made ones for the documents without any."""
    d = table(spark, sf_dir, "documents").withColumn("document", F.col("doc_id") % 300)
    stored = d.where("document < 100").select("document", F.col("doc_id").cast("string").alias("section"), F.col("source").alias("label"), F.col("lang").alias("text"))
    made = d.select("document").distinct().select("document", F.concat(F.lit("summary "), "document").alias("text"))
    return op.lexical_text(stored, made)


@query(f"WITH {_PUTS}, n AS (SELECT *, lag(digest) OVER w AS old FROM h WINDOW w AS (PARTITION BY document ORDER BY put)), k AS (SELECT * FROM n WHERE digest IS DISTINCT FROM old), z AS (SELECT document, digest, put AS known_from, lead(put) OVER (PARTITION BY document ORDER BY put) AS known_to FROM k) SELECT document, digest FROM z WHERE known_from <= 4 AND (known_to IS NULL OR 4 < known_to)")
def sections_as_of(spark, sf_dir):
    return op.sections_as_of(op.section_versions(_puts(spark, sf_dir)), F.lit(4)).select("document", "digest")
