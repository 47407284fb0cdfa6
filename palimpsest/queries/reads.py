"""Guards, pages and flat views of graph reads."""

from pyspark.sql import functions as F

from palimpsest.operators import reads as op
from palimpsest.operators import resolution
from palimpsest.registry import query
from palimpsest.sources import model as m
from palimpsest.sources.model import table


@query("WITH r AS (SELECT DISTINCT 'host=h' || (c_custkey % 90) AS ref FROM customer), c AS (SELECT 'host=h' || (s_suppkey % 70) AS ref, min(s_suppkey) AS e FROM supplier GROUP BY 1) SELECT r.ref, CASE WHEN e % 3 = 0 THEN e + 1000 ELSE e END AS entity, e IS NOT NULL AS found FROM r LEFT JOIN c USING (ref)")
def focus_resolution(spark, sf_dir):
    """What a ref names, followed through merges."""
    i = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    merged = resolution.canonical(s.where(i % 3 == 0).select(i.alias("id"), (i + 1000).alias("merged_into")))
    return op.resolved_focus(table(spark, sf_dir, "customer").select(F.concat(F.lit("host=h"), F.col("c_custkey") % 90).alias("ref")), s.select(F.concat(F.lit("host=h"), i % 70).alias("ref"), i.alias("entity")), merged)


@query(f"WITH {m.V}, l AS (SELECT DISTINCT entity FROM v WHERE valid_from <= TIMESTAMP '2024-01-01 06:00:00' AND (valid_to IS NULL OR TIMESTAMP '2024-01-01 06:00:00' < valid_to)), x AS (SELECT min(observed_from) AS f FROM a) SELECT DISTINCT a.entity, CASE WHEN l.entity IS NULL THEN CASE WHEN TIMESTAMP '2024-01-01 06:00:00' < f + INTERVAL 12 HOUR THEN 'before_recorded_history' ELSE 'unknown' END END AS reason FROM a CROSS JOIN x LEFT JOIN l ON l.entity = a.entity")
def history_guard(spark, sf_dir):
    """Entities that the log was not yet watching."""
    from palimpsest.operators import temporal

    at = m.at("2024-01-01 06:00:00")
    a = m.assertions(spark, sf_dir)
    first = F.lit(a.agg(F.min("observed_from").alias("f")).first()["f"]).cast("timestamp") + m.hours(12)
    return op.before_history(a.select("entity").distinct(), m.versions(spark, sf_dir).where(temporal.valid_at(at)), at, first)


@query(f"WITH {m.A}, p AS (SELECT entity, 'p' || (k % 4) AS name, source, CAST(k % 5 AS VARCHAR) AS value, valid_from AS tm, event_id FROM a), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, name, source ORDER BY tm DESC, event_id DESC) AS n FROM p) q WHERE n = 1) SELECT entity, name, arg_max(value, (tm, source, event_id)) AS value, count(DISTINCT value) > 1 AS conflict FROM l GROUP BY 1, 2")
def flat_props(spark, sf_dir):
    """One value a property, and whether its sources' last words differ."""
    rows = m.assertions(spark, sf_dir).select("entity", F.concat(F.lit("p"), F.col("k") % 4).alias("name"), "source", (F.col("k") % 5).cast("string").alias("value"), F.col("valid_from").alias("at"), "event_id")
    return op.flat_props(rows)


_ORDER = ", ".join(f"'{p}'" for p in op.PRECEDENCE)


@query(f"WITH {m.A}, f AS (SELECT DISTINCT entity, [{_ORDER}, 'MYSTERY', 'OTHER'][1 + (user_id * 5 + k % 3) % 12] AS facet FROM a) SELECT entity, string_agg(facet, ',' ORDER BY facet) AS facets, [{_ORDER}][min(CASE WHEN list_position([{_ORDER}], facet) > 0 THEN list_position([{_ORDER}], facet) END)] AS type FROM f GROUP BY 1")
def typed_entities(spark, sf_dir):
    """Every entity's facets, and its type by the whole precedence."""
    names = F.array(*(F.lit(p) for p in (*op.PRECEDENCE, "MYSTERY", "OTHER")))
    facets = m.assertions(spark, sf_dir).select("entity", F.get(names, ((F.col("user_id") * 5 + F.col("k") % 3) % 12).cast("int")).alias("facet"))
    return op.typed(facets).withColumn("facets", F.array_join("facets", ","))


_REVIEW = "r AS (SELECT 'p' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id, 'c' || (o_custkey % 30) AS src, 'c' || (o_orderkey % 30) AS dst, round(o_orderkey % 10 / 10, 6) AS score, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status FROM orders)"


def _review(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.lpad(k.cast("string"), 8, "0")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 30).alias("src"), F.concat(F.lit("c"), k % 30).alias("dst"), F.round(k % 10 / 10, 6).alias("score"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "confirmed").otherwise("rejected").alias("status")).distinct()


@query(f"WITH {_REVIEW} SELECT DISTINCT id, score FROM r WHERE status = 'pending' AND (src = 'c6' OR dst = 'c6') ORDER BY score DESC, id LIMIT 15")
def proposed_dependencies(spark, sf_dir):
    """The first page of pending dependencies that touch a focus."""
    return op.review_page(_review(spark, sf_dir), "id", ["src", "dst"], "pending", "c6", None, 15).select("id", "score")


@query(f"WITH {_REVIEW} SELECT DISTINCT id, score, status FROM r WHERE score < 0.5 OR (score = 0.5 AND id > 'p00000300') ORDER BY score DESC, id LIMIT 15")
def list_proposals(spark, sf_dir):
    """A later page of proposals of any status."""
    return op.review_page(_review(spark, sf_dir), "id", ["src", "dst"], None, None, (0.5, "p00000300"), 15).select("id", "score", "status")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 = 0 AND role <> 'system' AND turn % 4 <> 1 AND turn % 5 <> 2")
def chat_scope(spark, sf_dir):
    """Messages of channels in scope, without bots' and without authors."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("channel", F.col("conv_id")).withColumn("bot", F.when(F.col("turn") % 4 == 1, True)).withColumn("author", F.when(F.col("turn") % 5 != 2, F.col("role")))
    return op.in_scope(c, c.where("conv_id % 3 = 0").select("channel")).select("conv_id", "turn")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'empty' WHEN o_orderkey % 6 = 1 THEN 'no_start' WHEN o_orderkey % 6 = 2 THEN 'end_known_and_unknown' END AS problem FROM orders")
def interval_validation(spark, sf_dir):
    k, at = F.col("o_orderkey") % 6, F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(~k.isin(1, 3), at).alias("valid_from"), F.when(k == 0, at).when(k == 2, at + m.hours(1)).when(k == 4, at + m.hours(2)).alias("valid_to"), (k == 3).alias("valid_from_unknown"), k.isin(2, 5).alias("valid_to_unknown"))
    return op.invalid_intervals(rows).select("id", "problem")


@query(
    f"""WITH {m.A}, w AS (SELECT event_id, valid_from AS s, valid_from + to_hours(CAST(1 + k % 60 AS INTEGER)) AS f FROM a), e AS (SELECT event_id, s, f, least(f, TIMESTAMP '{m.T2}' - INTERVAL 5 MINUTE) AS t FROM w), x AS (SELECT *, greatest(s, TIMESTAMP '2024-01-05', t - INTERVAL 24 HOUR) AS g FROM e)
    SELECT event_id, CASE WHEN g >= t THEN 'outside' WHEN g > s AND t < f THEN 'both' WHEN g > s THEN 'start' WHEN t < f THEN 'end' ELSE 'whole' END AS note FROM x"""
)
def window_clamp(spark, sf_dir):
    """Windows cut at the horizon less the lag, at what is kept, and to a day."""
    rows = m.assertions(spark, sf_dir).select("event_id", F.col("valid_from").alias("start"), (F.col("valid_from") + F.make_interval(hours=(1 + F.col("k") % 60).cast("int"))).alias("finish"))
    return op.clamped(rows, m.at(m.T2), 86400, m.at("2024-01-05 00:00:00"), 300).select("event_id", "note")


@query(f"WITH {m.A}, r AS (SELECT 'version' AS kind, event_id AS id, entity, observed_from AS tm FROM a WHERE entity IN ('u8', 'u9', 'u10') UNION ALL SELECT 'decision', user_id + 1000000, entity, TIMESTAMP '2024-01-15' FROM (SELECT DISTINCT entity, user_id FROM a WHERE entity IN ('u9', 'u10')) q) SELECT kind, id, entity, row_number() OVER (ORDER BY tm, kind, id) AS position FROM r")
def history_with_decisions(spark, sf_dir):
    """An entity's versions, those of what was merged into it, and the decisions that did."""
    a = m.assertions(spark, sf_dir)
    merged = a.where("entity IN ('u9', 'u10')").select("entity", "user_id").distinct()
    canonical = merged.select(F.col("entity").alias("id"), F.lit("u8").alias("canonical"))
    decisions = merged.select((F.col("user_id") + 1000000).alias("seq"), F.col("entity").alias("merged"), m.at("2024-01-15 00:00:00").alias("at"))
    return op.history(a, canonical, "u8", decisions).select("kind", "id", "entity", "position")


@query(f"WITH {m.C} SELECT change_id, CASE WHEN k % 5 = 0 AND start > TIMESTAMP '{m.T2}' THEN 'announced_in_future' WHEN k % 2 = 0 AND floor(epoch(TIMESTAMP '{m.T2}')) - floor(epoch(start + INTERVAL 1 HOUR)) > 7200 THEN 'stale' END AS excluded FROM c")
def candidate_gates(spark, sf_dir):
    """What isn't ranked: announced for later, or over long before the reference."""
    rows = m.changes(spark, sf_dir).withColumn("announced", F.col("k") % 5 == 0).withColumn("valid_end", F.when(F.col("k") % 2 == 0, F.col("start") + m.hours(1)))
    return op.ranked_candidates(rows, m.at(m.T2), 7200).select("change_id", "excluded")
