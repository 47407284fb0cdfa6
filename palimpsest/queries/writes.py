"""Write-side operators over the star tables: events of users as typed events."""

from pyspark.sql import functions as F

from palimpsest.operators import resolution
from palimpsest.operators import writes as op
from palimpsest.registry import query
from palimpsest.sources import model as m
from palimpsest.sources.model import table

_REFS = f"{m.A}, r AS (SELECT event_id, 'user=' || user_id AS src, 'user=' || ((user_id * 7 + k) % 120) AS dst, valid_from FROM a), c AS (SELECT DISTINCT 'user=' || user_id AS ref, entity FROM a WHERE user_id % 6 <> 0)"
_ENTITY = "coalesce({0}.entity, 'placeholder-' || substr(sha256(r.{1}), 1, 16))"
_RESOLVED = f"{_REFS}, e AS (SELECT r.event_id, r.src, r.dst, x.entity IS NULL AS ns, y.entity IS NULL AS nd, {_ENTITY.format('x', 'src')} AS src_entity, {_ENTITY.format('y', 'dst')} AS dst_entity FROM r LEFT JOIN c x ON x.ref = r.src LEFT JOIN c y ON y.ref = r.dst)"


def _edge_events(spark, sf_dir):
    a = m.assertions(spark, sf_dir)
    events = a.select("event_id", F.concat(F.lit("user="), "user_id").alias("src"), F.concat(F.lit("user="), (F.col("user_id") * 7 + F.col("k")) % 120).alias("dst"))
    return events, a.where("user_id % 6 <> 0").select(F.concat(F.lit("user="), "user_id").alias("ref"), "entity").distinct()


@query(f"WITH {_RESOLVED} SELECT event_id, src_entity, dst_entity FROM e WHERE src_entity <> dst_entity")
def upsert_edges(spark, sf_dir):
    """Edge events with their endpoints resolved; loops are dropped."""
    return op.resolved_edges(*_edge_events(spark, sf_dir))[0].select("event_id", "src_entity", "dst_entity")


@query(f"WITH {_RESOLVED}, p AS (SELECT src AS ref, src_entity AS entity, event_id FROM e WHERE ns UNION ALL SELECT dst, dst_entity, event_id FROM e WHERE nd) SELECT ref, entity, min(event_id) AS created_by FROM p GROUP BY 1, 2")
def placeholder_endpoints(spark, sf_dir):
    return op.resolved_edges(*_edge_events(spark, sf_dir))[1]


_CUTS = "x AS (SELECT src, dst, type, valid_from + INTERVAL 6 HOUR AS fin, edge_id + 1000000 AS cb FROM e WHERE edge_id % 4 = 0)"


@query(f"WITH {m.E}, {_CUTS}, h AS (SELECT e.edge_id, fin, cb, row_number() OVER (PARTITION BY e.edge_id ORDER BY fin, cb) AS n FROM e JOIN x ON e.src = x.src AND e.dst = x.dst AND e.type = x.type AND e.valid_from < fin AND (e.valid_to IS NULL OR fin < e.valid_to)) SELECT e.edge_id, epoch_us(coalesce(fin, e.valid_to)) AS valid_to, cb AS closed_by FROM e LEFT JOIN h ON h.edge_id = e.edge_id AND n = 1")
def retract_edge(spark, sf_dir):
    """Retractions of one edge in four, six hours after its start: each closes the edges that it falls into."""
    e = m.edges(spark, sf_dir)
    cuts = e.where("edge_id % 4 = 0").select("src", "dst", "type", (F.col("valid_from") + m.hours(6)).alias("valid_end"), (F.col("edge_id") + 1000000).alias("event_id"))
    return op.retract_edges(e, cuts).select("edge_id", m.micros("valid_to").alias("valid_to"), "closed_by")


def _change_events(spark, sf_dir):
    a, k = m.assertions(spark, sf_dir).where("state = 'error'"), F.col("k")
    return a.select(
        "event_id", F.concat(F.lit("change="), "event_id").alias("ref"), F.when(k % 4 != 0, F.col("valid_from")).alias("valid_at"), F.when(k % 3 == 0, F.col("valid_from") + m.hours(1)).alias("valid_end"),
        F.when(k % 8 != 0, F.col("valid_from") + m.hours(2)).alias("source_observed"), F.col("observed_from").alias("observed"), F.array(F.concat(F.lit("user="), "user_id"), F.concat(F.lit("user="), F.col("user_id") + 1)).alias("targets"),
    )


_STARTED = f"{m.A}, s AS (SELECT event_id, k, valid_from AS t, CASE WHEN k % 4 <> 0 THEN valid_from WHEN k % 8 <> 0 THEN valid_from + INTERVAL 2 HOUR ELSE observed_from END AS f, user_id FROM a WHERE state = 'error')"


@query(f"WITH {_STARTED} SELECT event_id, epoch_us(f) AS valid_from, epoch_us(CASE WHEN k % 3 = 0 THEN t + INTERVAL 1 HOUR ELSE f + INTERVAL 1 MICROSECOND END) AS valid_to, k % 4 = 0 AS from_unknown FROM s")
def observe_change(spark, sf_dir):
    """Changes as intervals: a microsecond where no end was told, from the source's own observation where no start was."""
    rows, _ = op.observed_changes(_change_events(spark, sf_dir), _edge_events(spark, sf_dir)[1])
    return rows.select("event_id", m.micros("valid_from").alias("valid_from"), m.micros("valid_to").alias("valid_to"), "from_unknown")


@query(f"WITH {_STARTED}, n AS (SELECT event_id, unnest([user_id, user_id + 1]) AS u FROM s), c AS (SELECT user_id, min(event_id) AS cb FROM a WHERE user_id % 6 = 0 AND user_id % 4 = 0 GROUP BY 1) SELECT n.event_id, 'user=' || u AS ref, 'u' || u AS entity, cb AS attached_by FROM n JOIN c ON c.user_id = n.u")
def attach_waiting(spark, sf_dir):
    """Targets that nothing claimed when the change came, attached by the first later claim."""
    _, targets = op.observed_changes(_change_events(spark, sf_dir), _edge_events(spark, sf_dir)[1])
    late = m.assertions(spark, sf_dir).where("user_id % 6 = 0 AND user_id % 4 = 0").select(F.concat(F.lit("user="), "user_id").alias("ref"), "entity", "event_id")
    return op.attached(targets, late)


@query(f"WITH {m.A}, t AS (SELECT entity AS monitor, source AS group_key, CASE WHEN value > 60 THEN 'alert' WHEN value > 30 THEN 'warn' ELSE 'ok' END AS state, valid_from AS tm, event_id FROM a), l AS (SELECT *, lag(state) OVER w AS old FROM t WINDOW w AS (PARTITION BY monitor, group_key ORDER BY tm, event_id)), n AS (SELECT * FROM l WHERE state IS DISTINCT FROM old) SELECT monitor, group_key, state, epoch_us(tm) AS valid_from, epoch_us(lead(tm) OVER (PARTITION BY monitor, group_key ORDER BY tm, event_id)) AS valid_to FROM n")
def alert_transition(spark, sf_dir):
    """Each group of a monitor is a lane of states."""
    state = F.when(F.col("value") > 60, "alert").when(F.col("value") > 30, "warn").otherwise("ok")
    rows = m.assertions(spark, sf_dir).select(F.col("entity").alias("monitor"), F.col("source").alias("group_key"), state.alias("state"), F.col("valid_from").alias("at"), "event_id")
    return op.alert_lanes(rows).withColumn("valid_from", m.micros("valid_from")).withColumn("valid_to", m.micros("valid_to"))


@query(f"WITH {m.A}, c AS (SELECT 'host' AS namespace, 'h' || (user_id % 40) AS value, source, entity, observed_from, event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE 'v' || k END AS av FROM a), l AS (SELECT namespace, value, source, arg_max(entity, (observed_from, event_id)) AS entity FROM c GROUP BY 1, 2, 3), f AS (SELECT namespace, value, source, arg_max(av, (observed_from, event_id)) AS version FROM c WHERE av IS NOT NULL GROUP BY 1, 2, 3) SELECT l.*, f.version FROM l LEFT JOIN f USING (namespace, value, source)")
def claim_store(spark, sf_dir):
    """The latest claim of an identifier keeps attributes that a later one leaves empty."""
    k = F.col("k")
    bag = F.when(k % 3 == 0, F.lit(None).cast("map<string,string>")).otherwise(F.create_map(F.lit("version"), F.concat(F.lit("v"), k)))
    claims = m.assertions(spark, sf_dir).select(F.lit("host").alias("namespace"), F.concat(F.lit("h"), F.col("user_id") % 40).alias("value"), "source", "entity", F.col("observed_from").alias("observed"), "event_id", F.coalesce(bag, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"))
    return op.claim_store(claims).select("namespace", "value", "source", "entity", F.col("attributes")["version"].alias("version"))


_DECISIONS = "d AS (SELECT c_custkey AS seq, 'c' || (c_custkey % 40) AS surviving, 'c' || (c_custkey % 40 + 40 + c_custkey % 3 * 40) AS merged, CASE c_custkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'split' WHEN 2 THEN 'confirm' WHEN 3 THEN 'manual_merge' ELSE 'auto_merge' END AS kind, c_custkey % 5 <> 4 AND c_custkey % 7 = 0 AS human FROM customer)"
_MERGED = f"{_DECISIONS}, l AS (SELECT surviving, merged, arg_max(kind, (human, seq)) AS kind FROM d GROUP BY 1, 2), z AS (SELECT merged AS id, min(surviving) AS canonical FROM l WHERE kind IN ('auto_merge', 'confirm', 'manual_merge') GROUP BY 1)"


def _redirects(spark, sf_dir):
    i = F.col("c_custkey")
    kind = F.when(i % 5 == 0, "reject").when(i % 5 == 1, "split").when(i % 5 == 2, "confirm").when(i % 5 == 3, "manual_merge").otherwise("auto_merge")
    return op.redirects(table(spark, sf_dir, "customer").select(i.alias("seq"), F.concat(F.lit("c"), i % 40).alias("surviving"), F.concat(F.lit("c"), i % 40 + 40 + i % 3 * 40).alias("merged"), kind.alias("kind"), ((i % 5 != 4) & (i % 7 == 0)).alias("human")))


@query(f"WITH {_MERGED} SELECT * FROM z")
def decisions_in_force(spark, sf_dir):
    """Merges in force, the last decision of a pair counting and a person's outranking a rule's; chains end at their last link."""
    return resolution.canonical(_redirects(spark, sf_dir))


@query(f"WITH {_MERGED}, s AS (SELECT 'c' || (o_custkey % 160) AS entity, o_orderkey AS event_id FROM orders) SELECT coalesce(canonical, entity) AS entity, entity AS stated_of, count(*) AS n FROM s LEFT JOIN z ON z.id = entity GROUP BY 1, 2")
def absorb_nodes(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 160).alias("entity"), F.col("o_orderkey").alias("event_id"))
    return op.absorbed(own, resolution.canonical(_redirects(spark, sf_dir))).groupBy("entity", "stated_of").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MERGED}, s AS (SELECT o_orderkey AS edge_id, 'c' || (o_custkey % 160) AS src, 'c' || (o_orderkey % 160) AS dst FROM orders) SELECT edge_id, coalesce(x.canonical, src) AS src, coalesce(y.canonical, dst) AS dst FROM s LEFT JOIN z x ON x.id = src LEFT JOIN z y ON y.id = dst WHERE coalesce(x.canonical, src) <> coalesce(y.canonical, dst)")
def absorb_edges(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("c"), F.col("o_custkey") % 160).alias("src"), F.concat(F.lit("c"), F.col("o_orderkey") % 160).alias("dst"))
    return op.absorbed_edges(own, resolution.canonical(_redirects(spark, sf_dir)))


@query("SELECT s_suppkey AS claim_id, CASE WHEN s_suppkey % 9 = 0 THEN 'new' || (s_suppkey % 4) ELSE 'e' || (s_suppkey % 12) END AS entity FROM supplier")
def split_entity(spark, sf_dir):
    i = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    return op.split_off(s.select(i.alias("claim_id"), F.concat(F.lit("e"), i % 12).alias("entity")), s.where(i % 9 == 0).select(i.alias("claim_id"), F.concat(F.lit("new"), i % 4).alias("to")))


@query(
    f"""WITH {_MERGED}, f AS (SELECT 'c' || (o_custkey % 160) AS a, 'c' || (o_orderkey % 160) AS b, 'P' || (o_orderkey % 3 + 1) AS rule, 0.5 + 0.1 * (o_orderkey % 4) AS score FROM orders), g AS (SELECT coalesce(x.canonical, a) AS a, coalesce(y.canonical, b) AS b, rule, score FROM f LEFT JOIN z x ON x.id = a LEFT JOIN z y ON y.id = b),
    h AS (SELECT least(a, b) || '|' || greatest(a, b) AS pair, rule, score, row_number() OVER (PARTITION BY least(a, b) || '|' || greatest(a, b) ORDER BY score DESC, rule DESC) AS n FROM g WHERE a <> b)
    SELECT pair, rule, round(score, 6)::DOUBLE AS score, CASE WHEN length(pair) % 4 = 0 THEN 'conflict' WHEN length(pair) % 4 = 1 THEN 'confirmed' ELSE 'pending' END AS status FROM h WHERE n = 1"""
)
def file_suggestions(spark, sf_dir):
    """Suggestions between surviving entities; what a person refused and a rule still finds is a conflict."""
    k = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 160).alias("a"), F.concat(F.lit("c"), k % 160).alias("b"), F.concat(F.lit("P"), k % 3 + 1).alias("rule"), F.round(0.5 + 0.1 * (k % 4), 6).alias("score"))
    canonical = resolution.canonical(_redirects(spark, sf_dir))
    none = spark.createDataFrame([], "pair string, kind string")
    pairs = op.filed_suggestions(found, none, canonical).select("pair").distinct()
    decided = pairs.select("pair", F.when(F.length("pair") % 4 == 0, "reject").when(F.length("pair") % 4 == 1, "confirm").alias("kind")).dropna()
    return op.filed_suggestions(found, decided, canonical)


_MOVES = """WITH RECURSIVE e AS (SELECT 'c' || (o_custkey % 60) || '|d' || (o_orderkey % 5) || '|depends_on' AS proposal, o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 2 THEN 'propose' WHEN o_orderkey % 4 = 2 THEN 'confirm' ELSE 'reject' END AS kind, 0.1 * (o_orderkey % 7) AS score FROM orders),
 o AS (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY seq, kind) AS i FROM e), f AS (SELECT proposal, 0::BIGINT AS i, NULL::VARCHAR AS status, NULL::DOUBLE AS score, 0 AS n FROM o WHERE i = 1
 UNION ALL SELECT o.proposal, o.i, CASE WHEN o.kind = 'propose' THEN CASE WHEN f.status IS NULL THEN 'pending' WHEN f.status = 'rejected' THEN 'conflict' ELSE f.status END WHEN f.status IS NULL THEN NULL WHEN o.kind = 'confirm' THEN 'confirmed' ELSE 'rejected' END,
 CASE WHEN o.kind = 'propose' AND (f.status IS NULL OR f.status = 'pending') THEN o.score ELSE f.score END, f.n + CASE WHEN f.status IS NOT NULL OR o.kind = 'propose' THEN 1 ELSE 0 END FROM f JOIN o ON o.proposal = f.proposal AND o.i = f.i + 1)
 SELECT proposal, status, 'P4' AS rule, round(score, 6)::DOUBLE AS score, n AS n_events FROM f x WHERE i = (SELECT max(i) FROM o WHERE o.proposal = x.proposal) AND status IS NOT NULL"""


@query(_MOVES)
def dependency_proposals(spark, sf_dir):
    """Proposals, confirmations and rejections of directed dependencies, folded in order."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 < 2, "propose").when(k % 4 == 2, "confirm").otherwise("reject")
    events = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 60).alias("src"), F.concat(F.lit("d"), k % 5).alias("dst"), F.lit("depends_on").alias("type"), k.alias("seq"), kind.alias("kind"), F.lit("P4").alias("rule"), (0.1 * (k % 7)).alias("score"))
    return op.dependency_proposals(events).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {m.A}, w AS (SELECT entity, event_id, valid_from, valid_from + INTERVAL 2 DAY AS valid_to FROM a WHERE k % 2 = 0), d AS (SELECT w.event_id AS segment, y.valid_from AS tm, max(y.event_id) AS event_id FROM w JOIN a y ON y.entity = w.entity AND y.k % 4 = 0 AND y.valid_from > w.valid_from AND y.valid_from < w.valid_to GROUP BY 1, 2),
    s AS (SELECT event_id AS segment, valid_from AS tm, event_id FROM w UNION ALL SELECT * FROM d) SELECT segment, epoch_us(tm) AS valid_from, epoch_us(coalesce(lead(tm) OVER (PARTITION BY segment ORDER BY tm), w.valid_to)) AS valid_to, s.event_id FROM s JOIN w ON w.event_id = segment"""
)
def restatements(spark, sf_dir):
    """Segments of two days cut again wherever their entity was restated inside them."""
    a = m.assertions(spark, sf_dir)
    segments = a.where("k % 2 = 0").select(F.col("event_id").alias("segment"), "entity", "source", "valid_from", (F.col("valid_from") + m.hours(48)).alias("valid_to"), "event_id")
    again = segments.select("segment", "entity").join(a.where("k % 4 = 0").select("entity", F.col("valid_from").alias("at"), "event_id"), "entity").select("segment", "at", "event_id")
    return op.restated(segments, again).select("segment", m.micros("valid_from").alias("valid_from"), m.micros("valid_to").alias("valid_to"), "event_id")


@query(f"WITH {m.A} SELECT state AS type, count(*) AS events FROM a GROUP BY 1")
def apply_dispatcher(spark, sf_dir):
    """Every kind of event goes to its handler; those without one are told apart, none here."""
    a = m.assertions(spark, sf_dir).withColumnRenamed("state", "type")
    count = lambda rows: rows.groupBy("type").agg(F.count(F.lit(1)).alias("events"))
    kinds = ("click", "error", "purchase", "signup", "view")
    done, rest = op.dispatched(a, dict.fromkeys(kinds, count))
    out = count(rest)
    for rows in done.values():
        out = out.unionByName(rows)
    return out


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - 1 - s_suppkey % 3 AS b FROM supplier WHERE s_suppkey % 8 >= 3), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT DISTINCT a, b FROM r")
def drain_to_fixpoint(spark, sf_dir):
    """Pairs that follow from pairs, until no new one does."""
    i = F.col("s_suppkey")
    start = table(spark, sf_dir, "supplier").where(i % 8 >= 3).select(i.alias("a"), (i - 1 - i % 3).alias("b"))
    return op.until_settled(lambda found: found.withColumnRenamed("b", "x").join(start.withColumnsRenamed({"a": "x"}), "x").select("a", "b"), start)
