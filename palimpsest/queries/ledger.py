"""Ledger queries: orders as hypotheses of a customer's incident."""

from pyspark.sql import functions as F

from palimpsest.operators import ledger as op
from palimpsest.registry import query
from palimpsest.sources import model as m

_APPORTION = "(SELECT *, floor(greatest(share, 0) * 1000000) AS f, greatest(share, 0) * 1000000 - floor(greatest(share, 0) * 1000000) AS r FROM {0}) q"
_SCORES = "s AS (SELECT o_custkey AS incident, CAST(o_orderkey AS VARCHAR) AS hypothesis, CAST(o_orderkey % 7 AS DOUBLE) AS score FROM orders)"
_PRIORS = (
    _SCORES
    + """, t AS (SELECT *, sum(score) OVER (PARTITION BY incident) AS total FROM s), u AS (SELECT incident, hypothesis, CASE WHEN total > 0 THEN score / total * (1 - 0.25::DOUBLE) ELSE 0.0::DOUBLE END AS share FROM t
 UNION ALL SELECT incident, 'open', CASE WHEN sum(score) > 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END FROM s GROUP BY 1),
 v AS (SELECT incident, hypothesis, f, 1000000 - sum(f) OVER (PARTITION BY incident) AS rest, row_number() OVER (PARTITION BY incident ORDER BY r DESC, hypothesis) AS n FROM """
    + _APPORTION.format("u")
    + "), p AS (SELECT incident, hypothesis, (f + CASE WHEN n <= rest THEN 1 ELSE 0 END) / 1000000 AS prior FROM v)"
)


def _scores(spark, sf_dir):
    return m.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident"), F.col("o_orderkey").cast("string").alias("hypothesis"), (F.col("o_orderkey") % 7).cast("double").alias("score"))


def _judgments(spark, sf_dir):
    k = F.col("o_orderkey")
    direction = F.when(k % 3 == 0, "supports").when(k % 3 == 1, "refutes").otherwise("neutral")
    strength = F.when(k % 4 == 0, "weak").when(k % 4 == 1, "moderate").when(k % 4 == 2, "strong").otherwise("decisive")
    return m.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident"), k.cast("string").alias("hypothesis"), direction.alias("direction"), strength.alias("strength"))


_LN = "CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END * CASE o_orderkey % 4 WHEN 0 THEN 0.405465 WHEN 1 THEN 1.098612 WHEN 2 THEN 2.302585 ELSE 3.912023 END::DOUBLE"


@query(f"WITH {_PRIORS} SELECT * FROM p")
def priors(spark, sf_dir):
    return op.priors(_scores(spark, sf_dir), "incident", "hypothesis", 0.25)


@query(
    f"""WITH {_PRIORS}, e AS (SELECT CAST(o_orderkey AS VARCHAR) AS hypothesis, {_LN} AS l FROM orders), w AS (SELECT incident, p.hypothesis, CASE WHEN prior > 0 THEN ln(prior) + coalesce(l, 0) END AS w FROM p LEFT JOIN e ON e.hypothesis = p.hypothesis),
    x AS (SELECT *, CASE WHEN w IS NOT NULL THEN exp(w - max(w) OVER (PARTITION BY incident)) ELSE 0 END AS x FROM w), z AS (SELECT incident, hypothesis, round(x / sum(x) OVER (PARTITION BY incident), 9) AS share FROM x),
    y AS (SELECT incident, hypothesis, f, 1000000 - sum(f) OVER (PARTITION BY incident) AS rest, row_number() OVER (PARTITION BY incident ORDER BY r DESC, hypothesis) AS n FROM """
    + _APPORTION.format("z")
    + """) SELECT incident, hypothesis, (f + CASE WHEN n <= rest THEN 1 ELSE 0 END) / 1000000 AS posterior FROM y"""
)
def posteriors(spark, sf_dir):
    prior = op.priors(_scores(spark, sf_dir), "incident", "hypothesis", 0.25)
    return op.posteriors(prior, _judgments(spark, sf_dir), "incident", "hypothesis")


@query(f"WITH {_PRIORS} SELECT incident, CAST(round(sum(prior) * 1000000) AS BIGINT) AS units FROM p GROUP BY 1")
def apportion(spark, sf_dir):
    prior = op.priors(_scores(spark, sf_dir), "incident", "hypothesis", 0.25)
    return prior.groupBy("incident").agg(F.round(F.sum("prior") * op.UNITS).cast("long").alias("units"))


@query(f"WITH {_PRIORS} SELECT CASE WHEN prior < 0.1 THEN 'very_low' WHEN prior < 0.3 THEN 'low' WHEN prior < 0.6 THEN 'moderate' WHEN prior < 0.85 THEN 'high' ELSE 'very_high' END AS bucket, count(*) AS n FROM p GROUP BY 1")
def buckets(spark, sf_dir):
    prior = op.priors(_scores(spark, sf_dir), "incident", "hypothesis", 0.25)
    return prior.groupBy(op.bucket(F.col("prior")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_custkey AS incident, CAST(o_orderkey % 5 AS VARCHAR) AS hypothesis, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS supports, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS refutes, round(sum({_LN}), 6) AS net FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (WHERE o_orderkey % 3 = 0) > 0 AND count(*) FILTER (WHERE o_orderkey % 3 = 1) > 0")
def conflicts(spark, sf_dir):
    rows = _judgments(spark, sf_dir).withColumn("hypothesis", (F.col("hypothesis").cast("long") % 5).cast("string"))
    return op.conflicts(rows)


@query(
    """WITH l AS (SELECT user_id, event_id, round(value / 10000, 6) AS l1 FROM events), w AS (SELECT user_id, event_id, count(*) OVER x AS n, round(sum(l1) OVER x, 6) AS moved FROM l WINDOW x AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id FROM w WHERE n = 5 AND moved < 0.015"""
)
def diminishing_returns(spark, sf_dir):
    moves = m.table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") / 10000, 6).alias("l1"))
    return op.settled(moves, "user_id", "event_id", 0.015).select("user_id", "event_id")


@query(
    f"""WITH {m.C}, g AS (SELECT *, CASE WHEN lag(start) OVER w IS NULL OR start - lag(start) OVER w > INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY target ORDER BY start, change_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY start, change_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT change_id, first_value(change_id) OVER (PARTITION BY target, run ORDER BY start, change_id) AS incident FROM r"""
)
def incident_grouping(spark, sf_dir):
    alerts = m.changes(spark, sf_dir).withColumnRenamed("target", "entity")
    return op.grouped_incidents(alerts, 600).select("change_id", "incident")


_HYP = "h AS (SELECT o_custkey AS incident, CAST(o_orderkey AS VARCHAR) AS hypothesis, round((o_orderkey % 41) / 50, 6) AS confidence, CASE o_orderkey % 6 WHEN 0 THEN 'refuted' WHEN 1 THEN 'exonerated' WHEN 2 THEN 'supported' WHEN 3 THEN 'untested' ELSE 'proposed' END AS status, o_orderkey % 4 = 2 AS evidenced FROM orders)"


def _hypotheses(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 6 == 0, "refuted").when(k % 6 == 1, "exonerated").when(k % 6 == 2, "supported").when(k % 6 == 3, "untested").otherwise("proposed")
    return m.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("incident"), k.cast("string").alias("hypothesis"), F.round((k % 41) / 50, 6).alias("confidence"), status.alias("status"), (k % 4 == 2).alias("evidenced"))


@query(
    f"""WITH RECURSIVE {_HYP}, l AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY confidence DESC, hypothesis) AS n FROM h WHERE status NOT IN ('refuted', 'exonerated') AND confidence > 0),
    w AS (SELECT incident, hypothesis, confidence, n, confidence AS leader, n AS run FROM l WHERE n = 1 UNION ALL SELECT l.incident, l.hypothesis, l.confidence, l.n, CASE WHEN round(w.leader - l.confidence, 6) <= 0.05 THEN w.leader ELSE l.confidence END, CASE WHEN round(w.leader - l.confidence, 6) <= 0.05 THEN w.run ELSE l.n END FROM w JOIN l ON l.incident = w.incident AND l.n = w.n + 1)
    SELECT incident, string_agg(hypothesis, ',' ORDER BY n) AS hypotheses, round(max(confidence) - min(confidence), 6) AS spread FROM w GROUP BY incident, run HAVING count(*) > 1"""
)
def non_separable(spark, sf_dir):
    """Candidates that the evidence doesn't tell apart."""
    return op.non_separable(_hypotheses(spark, sf_dir)).withColumn("hypotheses", F.array_join("hypotheses", ","))


@query(
    f"""WITH {_HYP}, b AS (SELECT *, CASE WHEN confidence < 0.1 THEN 1 WHEN confidence < 0.3 THEN 2 WHEN confidence < 0.6 THEN 3 WHEN confidence < 0.85 THEN 4 ELSE 5 END AS b, CAST(hypothesis AS BIGINT) % 5 AS w FROM h), x AS (SELECT *, CASE w WHEN 0 THEN least(b + 1, 5) WHEN 1 THEN greatest(b - 1, 1) ELSE b END AS r FROM b)
    SELECT hypothesis, ['very_low', 'low', 'moderate', 'high', 'very_high'][CASE WHEN evidenced THEN r ELSE least(r, 3) END] AS bucket FROM x"""
)
def reported_buckets(spark, sf_dir):
    """Buckets a step up or down where tests were cut short, and no higher than moderate without evidence."""
    w = F.col("hypothesis").cast("long") % 5
    widened = F.when(w == 0, "up").when(w == 1, "down")
    return _hypotheses(spark, sf_dir).select("hypothesis", op.reported_bucket(F.col("confidence"), widened, F.col("evidenced")).alias("bucket"))


@query("SELECT o_orderkey AS judgment, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) = 1 AS accepted FROM orders")
def one_judgment(spark, sf_dir):
    rows = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("judgment"), F.col("o_custkey").alias("evidence"), (F.col("o_orderkey") % 3).alias("hypothesis"))
    return op.one_judgment(rows, "judgment").select("judgment", "accepted")


@query(
    """WITH x AS (SELECT o_orderkey AS id, ['compare', 'errors_by_version', 'new_log_patterns', 'error_spans', 'topology'][o_orderkey % 5 + 1] AS c, ['DIGEST', 'DIGEST', 'NO_DATA', 'PARTIAL'][o_orderkey % 4 + 1] AS o, o_orderkey % 3 AS s, o_orderkey % 2 = 0 AS up, list_slice([o_orderkey % 11 / 100, o_orderkey % 7 / 100, o_orderkey % 13 / 100], 1, o_orderkey % 4) AS r, o_orderkey % 3 AS n FROM orders),
    y AS (SELECT *, list_reverse_sort(r) AS q FROM x),
    d AS (SELECT id, CASE WHEN o = 'NO_DATA' THEN CASE WHEN c IN ('compare', 'errors_by_version') THEN 'refutes weak' ELSE 'neutral ' END WHEN o <> 'DIGEST' THEN NULL WHEN c = 'compare' THEN CASE WHEN s = 0 THEN NULL WHEN s = 1 THEN 'neutral ' WHEN up THEN 'supports moderate' ELSE 'refutes weak' END
    WHEN c = 'errors_by_version' THEN CASE WHEN len(q) > 1 AND q[1] > 0 AND q[1] >= 2 * q[2] THEN 'supports strong' WHEN len(q) > 1 THEN 'refutes moderate' WHEN len(q) = 1 AND q[1] >= 0.05 THEN 'supports moderate' END WHEN c = 'new_log_patterns' THEN CASE WHEN n >= 1 THEN 'supports moderate' ELSE 'neutral ' END WHEN c = 'error_spans' THEN CASE WHEN n > 0 THEN 'supports moderate' ELSE 'neutral ' END END AS v FROM y)
    SELECT id, v AS verdict FROM d"""
)
def first_wave(spark, sf_dir):
    """What an answer says about the hypothesis that its call served."""
    k = F.col("o_orderkey")
    of = lambda names, i: F.get(F.array(*(F.lit(n) for n in names)), i.cast("int"))
    rates = F.slice(F.array((k % 11) / 100, (k % 7) / 100, (k % 13) / 100), F.lit(1), F.least(k % 4, F.lit(3)).cast("int"))
    told = op.first_wave(of(("compare", "errors_by_version", "new_log_patterns", "error_spans", "topology"), k % 5), of(("DIGEST", "DIGEST", "NO_DATA", "PARTIAL"), k % 4), F.when(k % 3 != 0, k % 3 == 2), k % 2 == 0, rates, k % 3)
    return m.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(told.isNotNull(), F.concat(told["direction"], F.lit(" "), F.coalesce(told["strength"], F.lit("")))).alias("verdict"))


@query(
    """WITH x AS (SELECT o_orderkey AS id, ['proposed', 'supported', 'untested', 'exonerated', 'refuted', 'inconclusive', 'gone'][o_orderkey % 7 + 1] AS s, o_orderkey % 2 = 0 AS e, o_orderkey % 3 = 0 AS k, o_orderkey % 5 > 1 AS r, o_orderkey % 4 > 0 AS n, o_orderkey % 6 < 3 AS o FROM orders)
    SELECT id, CASE s WHEN 'proposed' THEN 'never_returns_to_proposed' WHEN 'supported' THEN CASE WHEN k THEN 'only_a_document' WHEN NOT e THEN 'unsupported_status' END WHEN 'untested' THEN CASE WHEN NOT (r AND n) THEN 'untested_without_next_query' END WHEN 'exonerated' THEN CASE WHEN NOT o THEN 'no_onset_estimate' END WHEN 'gone' THEN 'unknown_status' END AS refusal FROM x"""
)
def status_machine(spark, sf_dir):
    k = F.col("o_orderkey")
    to = F.get(F.array(*(F.lit(n) for n in ("proposed", "supported", "untested", "exonerated", "refuted", "inconclusive", "gone"))), (k % 7).cast("int"))
    return m.table(spark, sf_dir, "orders").select(k.alias("id"), op.status_refusal(to, k % 2 == 0, k % 3 == 0, k % 5 > 1, k % 4 > 0, k % 6 < 3).alias("refusal"))


@query(
    f"""WITH {_HYP}, o AS (SELECT incident, CASE WHEN row_number() OVER (PARTITION BY incident ORDER BY hypothesis) = 1 AND incident % 3 <> 0 THEN 'open' ELSE hypothesis END AS hypothesis, confidence, status, evidenced FROM h),
    n AS (SELECT incident, arg_min(hypothesis, (-confidence, hypothesis)) AS hypothesis FROM o WHERE hypothesis <> 'open' AND status = 'supported' AND evidenced GROUP BY 1)
    SELECT o.incident, CASE WHEN max(n.hypothesis) IS NOT NULL THEN 'named' WHEN bool_or(o.hypothesis = 'open' AND status = 'supported') THEN 'unobserved' ELSE 'unknown' END AS verdict, coalesce(max(n.hypothesis), max(CASE WHEN o.hypothesis = 'open' THEN 'open' END)) AS hypothesis FROM o LEFT JOIN n ON n.incident = o.incident GROUP BY 1"""
)
def verdicts(spark, sf_dir):
    """The supported candidate with the most confidence, or the open hypothesis, or none."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy("incident").orderBy("hypothesis")) == 1
    rows = _hypotheses(spark, sf_dir).withColumn("hypothesis", F.when(first & (F.col("incident") % 3 != 0), op.OPEN).otherwise(F.col("hypothesis")))
    return op.verdicts(rows)


@query(f"WITH {m.C}, n AS (SELECT target, min(start) + INTERVAL 3 DAY AS onset FROM c GROUP BY 1) SELECT c.target, change_id AS change FROM c JOIN n USING (target) WHERE epoch(c.start) - epoch(onset) > 3600 * (1 + CAST(substr(target, 2) AS BIGINT) % 5)")
def candidate_effects(spark, sf_dir):
    """Changes that began after the onset by more than it is uncertain."""
    c = m.changes(spark, sf_dir)
    seconds = lambda t: F.unix_micros(t) / 1e6
    onset = c.groupBy("target").agg((seconds(F.min("start")) + 3 * 86400).alias("at")).withColumn("uncertainty", 3600 * (1 + F.expr("cast(substr(target, 2) as long)") % 5))
    return op.candidate_effects(c.select("target", F.col("change_id").alias("change"), seconds("start").alias("start")), onset, "target")


@query("WITH e AS (SELECT user_id, event_id % 1000 AS tm, event_id % 7 AS u FROM events WHERE event_id % 3 = 0) SELECT user_id, min(tm) AS at, arg_min(u, (tm, u)) AS uncertainty FROM e GROUP BY 1")
def earliest_onset(spark, sf_dir):
    e = m.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 1000).alias("at"), (F.col("event_id") % 7).alias("uncertainty"), (F.col("event_id") % 3 == 0).alias("confident"))
    return op.earliest_onset(e, "user_id")


@query("WITH p AS (SELECT user_id, event_id // 50 AS call, CAST(event_id % 3 AS VARCHAR) AS h, max(round(value / 1000, 6)) AS posterior FROM events GROUP BY 1, 2, 3), d AS (SELECT *, abs(posterior - coalesce(lag(posterior) OVER (PARTITION BY user_id, h ORDER BY call), posterior)) AS d FROM p) SELECT user_id, call, round(sum(d), 6) AS l1 FROM d GROUP BY 1, 2")
def posterior_moves(spark, sf_dir):
    """How far each call moved the posterior."""
    p = m.table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 50).alias("call"), (F.col("event_id") % 3).cast("string").alias("h")).agg(F.max(F.round(F.col("value") / 1000, 6)).alias("posterior"))
    return op.moved(p, "user_id", "call", "h")


@query(
    """WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderkey AS o, round(o_orderkey % 23 * 1.0, 6) AS cost, o_orderkey % 5 = 0 AS fin, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    r AS (SELECT g, 0::BIGINT AS n, NULL::BIGINT AS o, NULL::BOOLEAN AS ok, 0.0::DOUBLE AS spent FROM c WHERE n = 1 UNION ALL SELECT c.g, c.n, c.o, r.spent + c.cost <= CASE WHEN c.fin THEN 100 ELSE 85 END, CASE WHEN r.spent + c.cost <= CASE WHEN c.fin THEN 100 ELSE 85 END THEN r.spent + c.cost ELSE r.spent END FROM r JOIN c ON c.g = r.g AND c.n = r.n + 1)
    SELECT g AS o_custkey, o AS call, ok AS admitted, spent FROM r WHERE n > 0"""
)
def budget_admission(spark, sf_dir):
    """Calls within a cap of which 15 % is kept for the last ones."""
    k = F.col("o_orderkey")
    calls = m.table(spark, sf_dir, "orders").select("o_custkey", k.alias("call"), (k % 23).cast("double").alias("cost"), (k % 5 == 0).alias("final"))
    return op.admitted(calls, "o_custkey", "call", 100.0)


@query(f"WITH {m.A}, w AS (SELECT event_id AS window, source, valid_from AS f, valid_from + INTERVAL 1 HOUR AS t FROM a), g AS (SELECT source, valid_from AS f, valid_from + INTERVAL 30 MINUTE AS t FROM a WHERE k % 50 = 0) SELECT window, EXISTS (SELECT 1 FROM g WHERE g.source = w.source AND w.f < g.t AND g.f < w.t) AS in_gap FROM w".replace("AS window", 'AS "window"').replace("SELECT window", 'SELECT "window"'))
def gap_overlap(spark, sf_dir):
    """Windows that a gap of their source's log overlaps."""
    a = m.assertions(spark, sf_dir)
    windows = a.select(F.col("event_id").alias("window"), "source", "valid_from", (F.col("valid_from") + m.hours(1)).alias("valid_to"))
    gaps = a.where("k % 50 = 0").select("source", F.col("valid_from").alias("gap_from"), (F.col("valid_from") + F.expr("INTERVAL 30 MINUTES")).alias("gap_to"))
    return op.gap_overlap(windows, gaps).select("window", "in_gap")


@query(
    f"""WITH RECURSIVE {m.C}, n AS (SELECT 'u' || i AS src, 'u' || (i + 1) AS dst FROM range(0, 2000) t(i) WHERE i % 3 = 0), p AS (SELECT x.change_id AS a, y.change_id AS b FROM c x JOIN c y ON x.change_id <> y.change_id AND abs(epoch_us(x.start) - epoch_us(y.start)) <= 30 * 60000000
    AND (x.target = y.target OR EXISTS (SELECT 1 FROM n WHERE (n.src = x.target AND n.dst = y.target) OR (n.dst = x.target AND n.src = y.target)))), r AS (SELECT change_id AS a, change_id AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
    SELECT a AS alert, min(b) AS incident FROM r GROUP BY 1"""
)
def incidents_by_hop(spark, sf_dir):
    """Alerts of one entity, or of two joined by an edge, within half an hour of each other are one incident."""
    alerts = m.changes(spark, sf_dir).select(F.col("change_id").alias("alert"), F.col("target").alias("entity"), F.col("start").alias("at"))
    i = F.col("id")
    edges = spark.range(2000).where(i % 3 == 0).select(F.concat(F.lit("u"), i).alias("src"), F.concat(F.lit("u"), i + 1).alias("dst"))
    return op.neighbouring_incidents(alerts, edges, 30)
