"""Projection queries: state at an instant, version upkeep, change folding."""

from pyspark.sql import functions as F

from palimpsest.operators import projection as op
from palimpsest.registry import query
from palimpsest.sources import model as m

_INSTANTS = f"valid_from <= TIMESTAMP '{m.T2}' AND observed_from <= TIMESTAMP '{m.KNOWN}'"
_STATE = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, source ORDER BY valid_from DESC, event_id DESC) AS n FROM a WHERE {_INSTANTS}) q WHERE n = 1)"


def _retractions(spark, sf_dir):
    rows = m.assertions(spark, sf_dir).where("k % 50 = 0")
    return rows.select("entity", "event_id", F.col("valid_from").alias("valid_end"), "observed_from")


@query(f"WITH {m.A}, {_STATE} SELECT entity, source, state FROM b")
def state_closed_form(spark, sf_dir):
    return op.state_at(m.assertions(spark, sf_dir), None, m.at(m.T2), m.at(m.KNOWN))


@query(
    f"""WITH {m.A}, r AS (SELECT entity, max(valid_from) AS cut FROM a WHERE k % 50 = 0 AND {_INSTANTS} GROUP BY 1), {_STATE}
    SELECT b.entity, b.source, b.state FROM b LEFT JOIN r ON r.entity = b.entity WHERE r.cut IS NULL OR b.valid_from >= r.cut"""
)
def state_with_retractions(spark, sf_dir):
    return op.state_at(m.assertions(spark, sf_dir), _retractions(spark, sf_dir), m.at(m.T2), m.at(m.KNOWN))


@query(
    f"""WITH {m.A}, s AS (SELECT entity, source, state, epoch_us(valid_from) AS valid_from, event_id FROM a)
    SELECT entity, source, state, valid_from, lead(valid_from) OVER (PARTITION BY entity, source ORDER BY valid_from, event_id) AS valid_to FROM s"""
)
def project_fold(spark, sf_dir):
    """Upserts alone, through the ordered fold, arriving late and out of order: the segments don't depend on it."""
    rows = m.assertions(spark, sf_dir).select(
        "entity", F.lit("upsert").alias("kind"), "source", "state", m.micros("valid_from").alias("t"), m.micros("observed_from").alias("observed"), F.col("event_id").alias("seq")
    )
    return op.project(rows)


@query(f"WITH {m.A} SELECT entity, event_id, state FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY valid_from DESC, source DESC, event_id DESC) AS n FROM a) q WHERE n = 1")
def primary_pick(spark, sf_dir):
    return op.primary(m.assertions(spark, sf_dir))


def _first_of(rows, k):
    return rows.where(k).groupBy("entity").agg(F.max_by("state", "event_id").alias("state"), F.max("observed_from").alias("observed_from"))


@query(
    f"""WITH {m.A}, x AS (SELECT entity, arg_max(state, event_id) AS state, max(observed_from) AS f FROM a WHERE k % 3 = 0 AND user_id % 7 <> 1 GROUP BY 1), y AS (SELECT entity, arg_max(state, event_id) AS state FROM a WHERE k % 3 = 1 AND user_id % 7 <> 2 GROUP BY 1),
    j AS (SELECT coalesce(x.entity, y.entity) AS entity, x.state AS xs, y.state AS ys, x.f, x.state IS NOT DISTINCT FROM y.state AS same FROM x FULL OUTER JOIN y ON x.entity = y.entity)
    SELECT entity, xs AS state, epoch_us(f) AS observed_from, CASE WHEN NOT same THEN epoch_us(TIMESTAMP '2024-03-01') END AS observed_to FROM j WHERE xs IS NOT NULL
    UNION ALL SELECT entity, ys, epoch_us(TIMESTAMP '2024-03-01'), NULL FROM j WHERE NOT same AND ys IS NOT NULL"""
)
def close_observed(spark, sf_dir):
    a = m.assertions(spark, sf_dir)
    stored, new = _first_of(a, "k % 3 = 0 AND user_id % 7 <> 1"), _first_of(a, "k % 3 = 1 AND user_id % 7 <> 2")
    out = op.close_observed(stored, new, ["entity"], ["state"], m.at("2024-03-01 00:00:00"))
    return out.select("entity", "state", m.micros("observed_from").alias("observed_from"), m.micros("observed_to").alias("observed_to"))


@query(
    f"""WITH {m.E}, r AS (SELECT entity, event_id, valid_from AS valid_end FROM a WHERE k % 50 = 0), t AS (SELECT e.edge_id, r.valid_end, r.event_id FROM e JOIN r ON r.entity IN (e.src, e.dst) WHERE e.valid_from < r.valid_end AND r.valid_end < e.valid_to)
    SELECT edge_id, epoch_us(valid_end) AS valid_to, event_id AS closed_as_consequence_of FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY valid_end, event_id) AS n FROM t) q WHERE n = 1"""
)
def edge_cascade(spark, sf_dir):
    out = op.cascade(m.edges(spark, sf_dir), _retractions(spark, sf_dir))
    return out.select("edge_id", m.micros("valid_to").alias("valid_to"), "closed_as_consequence_of")


@query(
    f"""WITH {m.A}, c AS (SELECT event_id, 'ref' || (event_id % 500) AS ref, source, CASE WHEN k % 4 <> 0 THEN epoch_us(valid_from) END AS start, CASE WHEN k % 3 <> 0 THEN 'actor' || (k % 5) END AS actor, CASE WHEN k % 2 = 0 THEN state END AS kind, observed_from FROM a),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref, source ORDER BY observed_from DESC, event_id DESC) AS n FROM c) q WHERE n = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY start IS NULL, start, source, event_id) AS p FROM l)
    SELECT ref, min(start) AS start, arg_min(actor, p) FILTER (WHERE actor IS NOT NULL) AS actor, arg_min(kind, p) FILTER (WHERE kind IS NOT NULL) AS kind, string_agg(event_id, ',' ORDER BY event_id) AS produced_by FROM o GROUP BY ref"""
)
def change_fold(spark, sf_dir):
    rows = m.assertions(spark, sf_dir).select(
        "event_id", F.concat(F.lit("ref"), F.col("event_id") % 500).alias("ref"), "source", F.when(F.col("k") % 4 != 0, m.micros("valid_from")).alias("start"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("actor"), F.col("k") % 5)).alias("actor"), F.when(F.col("k") % 2 == 0, F.col("state")).alias("kind"), "observed_from",
    )
    return op.fold_changes(rows).withColumn("produced_by", F.array_join(F.transform("produced_by", lambda x: x.cast("string")), ","))


@query(f"WITH {m.A} SELECT entity, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS produced_by FROM a GROUP BY 1")
def provenance(spark, sf_dir):
    return op.provenance(m.assertions(spark, sf_dir), "entity").withColumn("produced_by", F.array_join(F.transform("produced_by", lambda x: x.cast("string")), ","))


_FACETS = "service,workload,database,cluster"


@query(f"WITH {m.A} SELECT entity, string_agg(DISTINCT f, ',' ORDER BY f) AS facets, list_extract(['service', 'workload', 'database', 'cluster'], CAST(min(list_position(['service', 'workload', 'database', 'cluster'], f)) AS BIGINT)) AS type FROM (SELECT entity, list_extract(['cluster', 'database', 'workload', 'service'], 1 + (user_id + k % 3) % 4) AS f FROM a) q GROUP BY 1")
def facet_precedence(spark, sf_dir):
    order, names = F.lit(_FACETS.split(",")), F.array(*(F.lit(x) for x in reversed(_FACETS.split(","))))
    rows = m.assertions(spark, sf_dir).select("entity", F.get(names, ((F.col("user_id") + F.col("k") % 3) % 4).cast("int")).alias("f"))
    out = rows.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("facets"), F.min(F.array_position(order, F.col("f"))).alias("p"))
    return out.select("entity", "facets", F.element_at(order, F.col("p").cast("int")).alias("type"))


@query(f"WITH {m.A}, p AS (SELECT entity, 'k' || (k % 6) AS name, source, arg_max(CAST(k % 4 AS VARCHAR), event_id) AS v FROM a GROUP BY 1, 2, 3) SELECT entity, name, string_agg(DISTINCT v, ',' ORDER BY v) AS said FROM p GROUP BY 1, 2 HAVING count(DISTINCT v) >= 2")
def property_conflicts(spark, sf_dir):
    """Properties of which two sources say different things, with all that is said."""
    last = m.assertions(spark, sf_dir).groupBy("entity", F.concat(F.lit("k"), F.col("k") % 6).alias("name"), "source").agg(F.max_by((F.col("k") % 4).cast("string"), "event_id").alias("v"))
    return last.groupBy("entity", "name").agg(F.array_sort(F.collect_set("v")).alias("s")).where(F.size("s") >= 2).select("entity", "name", F.array_join("s", ",").alias("said"))


@query()
def project_fold_retractions(spark, sf_dir):
    """Upserts and retractions of every entity through the ordered fold, in the order in which they arrived."""
    a = m.assertions(spark, sf_dir)
    columns = [m.micros("valid_from").alias("t"), m.micros("observed_from").alias("observed"), F.col("event_id").alias("seq")]
    ups = a.select("entity", F.lit("upsert").alias("kind"), "source", "state", *columns)
    cuts = a.where("k % 50 = 0").select("entity", F.lit("retract").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("state"), *columns[:2], (F.col("event_id") + 0.5).alias("seq"))
    return op.project(ups.withColumn("seq", F.col("seq").cast("double")).unionByName(cuts))
