"""Attribution queries over the star tables: customers as signals, segments as entries."""

from pyspark.sql import functions as F

from palimpsest.operators import attribution as op
from palimpsest.registry import query
from palimpsest.sources.model import table

_HITS = """h AS (SELECT o_custkey AS signal, o_orderpriority AS entry, 'R' || (o_orderkey % 4) AS rule, max(0.2 + 0.1 * (o_orderkey % 6))::DOUBLE AS score FROM orders GROUP BY 1, 2, 3),
 p AS (SELECT signal, entry, round(1.0 - product(1.0 - score), 4) AS score FROM h GROUP BY 1, 2)"""


def _probable(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    hits = o.select(F.col("o_custkey").alias("signal"), F.col("o_orderpriority").alias("entry"), F.concat(F.lit("R"), F.col("o_orderkey") % 4).alias("rule"), (0.2 + 0.1 * (F.col("o_orderkey") % 6)).alias("score"))
    return op.combined(hits, "signal", "entry")


@query(f"WITH {_HITS} SELECT signal, entry, round(score, 3) AS score FROM p")
def noisy_or(spark, sf_dir):
    return _probable(spark, sf_dir).withColumn("score", F.round("score", 3))


@query(
    f"""WITH {_HITS}, w AS (SELECT *, lead(score) OVER (PARTITION BY signal ORDER BY score DESC, entry) AS nxt, row_number() OVER (PARTITION BY signal ORDER BY score DESC, entry) AS n FROM p),
    s AS (SELECT signal, entry, score FROM w WHERE n = 1 AND score >= 0.8 AND (nxt IS NULL OR round(score - nxt, 4) >= 0.1))
    SELECT c_custkey AS signal, CASE WHEN c_custkey % 50 = 0 THEN 'corrected' WHEN c_custkey % 20 = 1 THEN c_mktsegment ELSE s.entry END AS entry,
    CASE WHEN c_custkey % 50 = 0 THEN 'correction' WHEN c_custkey % 20 = 1 THEN 'alias' WHEN s.entry IS NOT NULL THEN 'probable' ELSE 'unknown' END AS layer FROM customer LEFT JOIN s ON s.signal = c_custkey"""
)
def attribution_decide(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("signal"), F.col("c_mktsegment").alias("entry"))
    corrections = c.where("signal % 50 = 0").withColumn("entry", F.lit("corrected"))
    return op.decide(c, corrections, c.where("signal % 20 = 1"), _probable(spark, sf_dir)).select("signal", "entry", "layer")


@query(f"WITH {_HITS} SELECT signal, entry, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, entry) AS rank FROM p) q WHERE rank <= 3")
def attribution_suggestions(spark, sf_dir):
    return op.suggestions(_probable(spark, sf_dir)).select("signal", "entry", "rank")


_STACK = """WITH RECURSIVE d AS (SELECT o_custkey AS signal, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'revert' ELSE 'correct' END AS action, o_orderpriority AS entry, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderpriority FROM orders) o),
 w AS (SELECT signal, seq, action, entry, n, CASE WHEN action = 'revert' THEN []::VARCHAR[] ELSE [entry] END AS stack FROM d WHERE n = 1 UNION ALL SELECT d.signal, d.seq, d.action, d.entry, d.n, CASE WHEN d.action = 'revert' THEN list_slice(w.stack, 1, len(w.stack) - 1) ELSE list_append(w.stack, d.entry) END FROM w JOIN d ON d.signal = w.signal AND d.n = w.n + 1)"""


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("signal"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 4 == 0, "revert").otherwise("correct").alias("action"), F.col("o_orderpriority").alias("entry")).distinct()


@query(_STACK + " SELECT signal, stack[-1] AS entry FROM w x WHERE n = (SELECT max(n) FROM d WHERE d.signal = x.signal)")
def attribution_standing(spark, sf_dir):
    """Decisions with reverts, folded per signal."""
    return op.standing(_decisions(spark, sf_dir))


@query(_STACK + " SELECT signal, seq, action, entry, stack[-1] AS current FROM w")
def why_attributed(spark, sf_dir):
    """Every decision of a signal with what stood after it."""
    return op.why_attributed(_decisions(spark, sf_dir))


@query(
    """WITH d AS (SELECT p_partkey AS name, p_brand AS target FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'old' ELSE p_brand END AS target FROM part WHERE p_partkey % 4 <> 0),
    f AS (SELECT 'a' || p_partkey % 500 AS alias, p_partkey AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0), c AS (SELECT 'a' || p_partkey % 500 AS alias, p_partkey AS name FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 6 <> 1)
    SELECT 'entry' AS kind, coalesce(d.name, s.name) AS name, coalesce(d.target, s.target) AS target, CASE WHEN s.name IS NULL THEN 'declare' WHEN d.name IS NULL THEN 'extra' WHEN d.target <> s.target THEN 'update' ELSE 'keep' END AS action FROM d FULL OUTER JOIN s ON d.name = s.name
    UNION ALL SELECT 'alias', coalesce(f.name, c.name), coalesce(f.alias, c.alias), CASE WHEN c.name IS NULL THEN 'alias' WHEN f.name IS NOT NULL THEN 'keep' WHEN coalesce(f.name, c.name) % 3 <> 0 THEN 'retract' ELSE 'extra' END FROM f FULL OUTER JOIN c ON f.name = c.name AND f.alias = c.alias"""
)
def import_plan(spark, sf_dir):
    """What a file of entries and aliases would change; nothing is pruned."""
    i = F.col("name")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("target"))
    stored = p.where("name % 4 <> 0").withColumn("target", F.when(i % 7 == 0, "old").otherwise(F.col("target")))
    named = p.select(F.concat(F.lit("a"), i % 500).alias("alias"), "name")
    return op.import_plan(p.where("name % 3 <> 0"), stored, named.where("name % 3 <> 0 AND name % 5 <> 0"), named.where("name % 4 <> 0 AND name % 6 <> 1"))


_SIGNS = """n AS (SELECT c_custkey AS signal, CASE c_custkey % 4 WHEN 0 THEN 'checkout-' || (c_custkey % 30) || '-svc' WHEN 1 THEN 'shop checkout ' || (c_custkey % 30) ELSE 'other' || c_custkey END AS name FROM customer),
 g AS (SELECT 'e' || i AS entry, 'checkout ' || i AS name FROM range(0, 40) t(i)), x AS (SELECT n.signal, g.entry, n.name AS via, 'checkout ' || (signal % 30) = g.name AND signal % 4 = 0 AS same, CASE signal % 4 WHEN 0 THEN CASE WHEN signal % 30 = CAST(substr(entry, 2) AS INTEGER) THEN 1.0 ELSE 1 / 3 END ELSE CASE WHEN signal % 30 = CAST(substr(entry, 2) AS INTEGER) THEN 2 / 3 ELSE 1 / 4 END END AS j FROM n JOIN g ON signal % 4 < 2),
 h AS (SELECT signal, entry, CASE WHEN same THEN 'P1' ELSE 'P2' END AS rule, CASE WHEN same THEN 0.85 ELSE 0.45 + 0.4 * j END AS score, via FROM x WHERE same OR j >= 0.5
 UNION ALL SELECT c_custkey, 'e' || (c_custkey % 45), 'P3', 0.55, 'r' || (c_custkey % 45) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 45 < 40 UNION ALL SELECT c_custkey, 'e' || i, 'P4', 0.50, 'o' || (c_custkey % 20) FROM customer JOIN range(0, 40) t(i) ON i % 20 = c_custkey % 20),
 p AS (SELECT signal, entry, round(1.0 - product(1.0 - score), 4) AS score, string_agg(rule, '+' ORDER BY rule) AS rules, arg_max(via, (score, -ascii(substr(rule, 2, 1)))) AS via FROM h GROUP BY 1, 2)"""


def _signs(spark, sf_dir):
    i = F.col("c_custkey")
    c, e = table(spark, sf_dir, "customer"), spark.range(40).select(F.concat(F.lit("e"), "id").alias("entry"), "id")
    name = F.when(i % 4 == 0, F.concat(F.lit("checkout-"), i % 30, F.lit("-svc"))).when(i % 4 == 1, F.concat(F.lit("shop checkout "), i % 30)).otherwise(F.concat(F.lit("other"), i))
    return op.probable(
        c.select(i.alias("signal"), name.alias("name")), e.select("entry", F.concat(F.lit("checkout "), "id").alias("name")), c.where("c_custkey % 3 = 0").select(i.alias("signal"), F.concat(F.lit("r"), i % 45).alias("ref")), e.select("entry", F.concat(F.lit("r"), "id").alias("ref")),
        c.select(i.alias("signal"), F.concat(F.lit("o"), i % 20).alias("owner")), e.select("entry", F.concat(F.lit("o"), F.col("id") % 20).alias("owner")),
    )


@query(f"WITH {_SIGNS} SELECT signal, entry, round(score, 3)::DOUBLE AS score, rules, via FROM p")
def probable_scoring(spark, sf_dir):
    """Signs of names, topology and owners, the best of each rule, combined."""
    return _signs(spark, sf_dir).withColumn("score", F.round("score", 3))


@query(f"WITH {_SIGNS}, t AS (SELECT signal, max(CASE WHEN score < 0.8 THEN score ELSE 0 END) AS nxt, min(CASE WHEN score >= 0.8 THEN score END) AS low, count(*) FILTER (WHERE score >= 0.8) AS n, count(DISTINCT via) FILTER (WHERE score >= 0.8) AS v FROM p GROUP BY 1) SELECT signal, entry FROM p JOIN t USING (signal) WHERE score >= 0.8 AND n = v AND round(low - nxt, 4) >= 0.1")
def probable_decided(spark, sf_dir):
    """Entries at the threshold that lead by the margin and came by different names."""
    return op.decided_probable(_signs(spark, sf_dir)).select("signal", "entry")


@query(f"WITH {_HITS} SELECT c_custkey AS signal, CASE WHEN c_custkey % 50 = 0 THEN 'corrected' ELSE 'guess' END AS entry, CASE WHEN c_custkey % 50 = 0 THEN 'correction' ELSE 'classifier' END AS layer FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 3 = 0")
def classifier_layer(spark, sf_dir):
    """A classifier is asked only about what nothing else decides."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("signal"), F.lit("corrected").alias("entry"))
    none = c.where("false")
    guesses = c.where("signal % 3 = 0").select("signal", F.lit("guess").alias("entry"), F.lit(0.4).alias("score"))
    return op.decide(c, c.where("signal % 50 = 0"), none, none.withColumn("score", F.lit(1.0)), guesses).where("entry IS NOT NULL").select("signal", "entry", "layer")


_OBSERVED = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    f"""WITH n AS (SELECT 'e' || user_id AS entry, event_type AS display, CASE WHEN event_id % 6 = 0 THEN 'hidden' ELSE 'active' END AS status, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
    a AS (SELECT 'e' || user_id AS entry, 'alias' || (event_id % 5) AS alias, ts AS f, ts + INTERVAL 3 DAY AS t FROM events WHERE event_id % 9 = 0), l AS (SELECT entry, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM a WHERE f <= {_OBSERVED} AND {_OBSERVED} < t GROUP BY 1)
    SELECT n.entry, display, status, coalesce(aliases, '') AS aliases FROM n LEFT JOIN l ON l.entry = n.entry WHERE f <= {_OBSERVED} AND (t IS NULL OR {_OBSERVED} < t) AND status = 'active'"""
)
def catalog_entries(spark, sf_dir):
    """Active entries as known at an instant, their aliases grouped."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    entry = F.concat(F.lit("e"), "user_id").alias("entry")
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    entries = e.select(entry, F.col("event_type").alias("display"), F.when(F.col("event_id") % 6 == 0, "hidden").otherwise("active").alias("status"), F.col("ts").alias("observed_from"), later.alias("observed_to"))
    aliases = e.where("event_id % 9 = 0").select(entry, F.concat(F.lit("alias"), F.col("event_id") % 5).alias("alias"), F.col("ts").alias("observed_from"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("observed_to"))
    found = op.catalog(entries, aliases, F.lit("2024-01-15 00:00:00").cast("timestamp"), "active")
    return found.withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT c_custkey AS signal, c_mktsegment AS entry FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 40 ORDER BY c_custkey LIMIT 20")
def attributed_signals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("signal"), F.col("c_mktsegment").alias("entry"))
    return op.attributed_signals(c, "BUILDING", 40, 20)


@query("SELECT 'checkout' || (c_custkey % 50) AS name, count(*) AS signals, min(c_custkey) AS example FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 HAVING count(*) >= 3")
def discovery_candidates(spark, sf_dir):
    """Names that several unknown signals share under different spellings."""
    i = F.col("c_custkey")
    name = F.concat(F.when(i % 2 == 0, "shop/Checkout_").otherwise("checkout-"), i % 50, F.when(i % 4 == 1, "-svc").otherwise(""))
    return op.discovery_candidates(table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(i.alias("signal"), name.alias("name")), 3)


@query("SELECT DISTINCT o_custkey AS signal FROM orders WHERE o_orderkey % 200 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)")
def reattribute_affected(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("signal"), (F.col("o_orderkey") % 200).alias("ref"))
    return op.affected(own, table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("ref")))
