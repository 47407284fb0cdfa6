"""Evaluation queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import evaluation as op
from palimpsest.registry import query
from palimpsest.sources.model import table


@query(
    """WITH r AS (SELECT o_custkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus FROM orders), v AS (SELECT * FROM r WHERE o_orderstatus = 'F')
    SELECT query, round(1.0 / min(rank), 6)::DOUBLE AS reciprocal_rank, round(count(*) FILTER (WHERE rank <= 3) / count(*), 6) AS recall_at_k FROM v GROUP BY 1"""
)
def retrieval_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), "rank")
    return op.retrieval(ranked, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc")))


_P = "(l_orderkey % 101) / 100.0::DOUBLE"


@query(f"SELECT CAST(least(floor({_P} * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg({_P}), 6) AS forecast, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 6) AS observed, round(avg(({_P} - CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) ** 2), 6) AS brier FROM lineitem GROUP BY 1")
def brier_reliability(spark, sf_dir):
    return op.reliability(table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") % 101) / 100.0, F.col("l_returnflag") == "R")


@query(f"WITH q AS (SELECT {_P} AS p, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y FROM lineitem) SELECT round(avg((p - y) ** 2), 6) AS brier, round(-avg(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) AS log_loss FROM q")
def calibration_scores(spark, sf_dir):
    return op.scores(table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") % 101) / 100.0, F.col("l_returnflag") == "R")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value > 100) AS misses, round(count(*) FILTER (WHERE value > 100) / count(*), 6) AS rate FROM events GROUP BY 1")
def miss_rate(spark, sf_dir):
    return op.miss_rate(table(spark, sf_dir, "events"), "event_type", F.col("value") > 100)


@query("WITH c AS (SELECT c_mktsegment, round(count(*) FILTER (WHERE c_acctbal > 1000) / count(*), 6) AS ceiling FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT *, round(1 - ceiling, 6) AS prior FROM c")
def audit_ceiling(spark, sf_dir):
    return op.ceiling(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal") > 1000, F.col("c_nationkey") % 2 == 0)


@query("SELECT o_custkey, round(avg(CASE WHEN o_orderstatus <> 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS pass_at_1, CASE WHEN count(*) = count(*) FILTER (WHERE o_orderstatus <> 'F') THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_all FROM orders GROUP BY 1")
def pass_rates(spark, sf_dir):
    """Share of trials that pass, and whether every one did."""
    return op.passes(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") != "F")


@query(
    """WITH r AS (SELECT o_custkey, round(avg(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus <> 'F' THEN 1.0::DOUBLE ELSE 0 END END), 6) AS w, round(avg(CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderstatus <> 'F' THEN 1.0::DOUBLE ELSE 0 END END), 6) AS wo FROM orders GROUP BY 1)
    SELECT *, round(w - wo, 6) AS lift, round(w - wo, 6) < 0 AS harm FROM r WHERE w IS NOT NULL AND wo IS NOT NULL"""
)
def lift_and_harm(spark, sf_dir):
    """Pass rates of the trials with and without help."""
    helped, won = F.col("o_orderkey") % 2 == 0, (F.col("o_orderstatus") != "F").cast("double")
    rates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg(F.when(helped, won)), 6).alias("w"), F.round(F.avg(F.when(~helped, won)), 6).alias("wo"))
    return op.lift(rates.dropna(), "w", "wo")


@query("WITH f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 0), w AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0), b AS (SELECT * FROM f INTERSECT SELECT * FROM w), n AS (SELECT (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM w) AS w) SELECT round(b / f, 6) AS precision, round(b / w, 6) AS recall, round(2 * b / (f + w), 6) AS f1 FROM n")
def edge_f1(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return op.edge_f1(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 3 = 0"), ["l_suppkey", "l_partkey"])


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS want, list(o_orderpriority ORDER BY o_totalprice, o_orderkey) AS got FROM orders GROUP BY 1),
    t AS (SELECT o_custkey, want, got, 0 AS i, list_transform(range(len(got) + 1), lambda x: 0) AS line FROM o
    UNION ALL SELECT o_custkey, want, got, i + 1, list_reduce(range(1, len(got) + 1), lambda done, j: list_append(done, CASE WHEN got[j] = want[i + 1] THEN line[j] + 1 ELSE greatest(line[j + 1], done[-1]) END), [0]) FROM t WHERE i < len(want))
    SELECT o_custkey, round(line[-1] / len(want), 6) AS n FROM t WHERE i = len(want)"""
)
def ordered_overlap(spark, sf_dir):
    """Share of each customer's priorities by date that those by price have in the same order."""
    o = table(spark, sf_dir, "orders")
    both = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))).alias("d"), F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey", "o_orderpriority"))).alias("p"))
    return both.select("o_custkey", op.ordered_overlap(F.transform("d", lambda x: x["o_orderpriority"]), F.transform("p", lambda x: x["o_orderpriority"])).alias("n"))


@query(
    """WITH e AS (SELECT o_orderkey AS evidence, 'price ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 10 AS VARCHAR) || ' rate ' || (o_orderkey % 4) AS digest FROM orders),
    c AS (SELECT o_orderkey AS claim, 'rate is ' || (o_orderkey % 6) AS text, o_orderkey % 6 AS said, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS cites FROM orders)
    SELECT claim, CASE WHEN cites IS NULL THEN 'removed' WHEN NOT list_contains(regexp_extract_all(digest, '[0-9]+'), CAST(said AS VARCHAR)) THEN 'demoted' ELSE 'supported' END AS verdict FROM c LEFT JOIN e ON e.evidence = c.cites"""
)
def citation_check(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    evidence = o.select(k.alias("evidence"), F.concat(F.lit("price "), F.floor(F.col("o_totalprice")) % 10, F.lit(" rate "), k % 4).alias("digest"))
    claims = o.select(k.alias("claim"), F.concat(F.lit("rate is "), k % 6).alias("text"), F.when(k % 5 == 0, F.array().cast("array<long>")).otherwise(F.array(k)).alias("cites"))
    return op.citations(claims, evidence)


@query("WITH l AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 5 = 1) SELECT (SELECT count(*) FROM l) AS listed, (SELECT count(*) FROM l WHERE id IN (SELECT id FROM f)) AS matched, (SELECT count(*) FROM l WHERE id NOT IN (SELECT id FROM f)) AS missing, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM l)) AS extra, round((SELECT count(*) FROM l WHERE id IN (SELECT id FROM f)) / (SELECT count(*) FROM l), 6) AS ratio")
def deploy_coverage(spark, sf_dir):
    from palimpsest.operators.relational import reconcile

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    sides = reconcile(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 1"), "id")
    out = sides.agg(F.count_if(F.col("side") != "extra").alias("listed"), *(F.count_if(F.col("side") == s).alias(s) for s in ("matched", "missing", "extra")))
    return out.withColumn("ratio", F.round(F.col("matched") / F.col("listed"), 6))


_P = "p AS (SELECT o_orderkey, (o_orderkey % 97) / 96 AS p, CASE WHEN o_orderkey % 5 < 2 THEN 1.0 ELSE 0.0 END AS y FROM orders), b AS (SELECT CASE WHEN p < 0.1 THEN 'very_low' WHEN p < 0.3 THEN 'low' WHEN p < 0.6 THEN 'moderate' WHEN p < 0.85 THEN 'high' ELSE 'very_high' END AS bucket, p, y FROM p), g AS (SELECT bucket, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(y), 6)::DOUBLE AS observed FROM b GROUP BY 1)"


@query(f"WITH {_P} SELECT *, round(abs(forecast - observed), 6) AS gap FROM g")
def named_calibration(spark, sf_dir):
    k = F.col("o_orderkey")
    return op.named_calibration(table(spark, sf_dir, "orders"), (k % 97) / 96, k % 5 < 2)


@query(f"WITH {_P} SELECT round(sum(round(abs(forecast - observed), 6) * n) / sum(n), 6) AS error FROM g")
def calibration_error(spark, sf_dir):
    k = F.col("o_orderkey")
    return op.calibration_error(table(spark, sf_dir, "orders"), (k % 97) / 96, k % 5 < 2)


@query("WITH f AS (SELECT o_orderkey AS pair, 'R' || (o_custkey % 5) AS rule, 0.4 + 0.1 * (o_custkey % 5) AS score, o_orderkey % 3 = 0 AS t FROM orders) SELECT rule, count(*) AS n, count(*) FILTER (WHERE t) AS right, round(avg((score - CASE WHEN t THEN 1.0 ELSE 0 END) ** 2), 6)::DOUBLE AS brier, round(count(*) FILTER (WHERE t) / count(*), 6) AS precision FROM f GROUP BY 1".replace("AS right", 'AS "right"').replace("AS precision", 'AS "precision"'))
def resolution_quality(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey") % 5
    found = o.select(F.col("o_orderkey").alias("pair"), F.concat(F.lit("R"), c).alias("rule"), (0.4 + 0.1 * c).alias("score"))
    return op.resolution_quality(found.distinct(), found.where("pair % 3 = 0"))


@query("SELECT o_custkey % 10 AS incident, count(*) AS claims, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS valid FROM orders GROUP BY 1")
def citation_validity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("incident"), F.when(F.col("o_orderkey") % 3 == 0, "supported").otherwise("demoted").alias("verdict"))
    return op.citation_validity(rows, "incident")


@query("WITH l AS (SELECT o_custkey AS i, arg_max(CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, o_orderkey) FILTER (WHERE o_orderkey % 3 < 2) AS x, max(o_orderkey) AS m FROM orders GROUP BY 1), q AS (SELECT CASE (SELECT 1) WHEN 1 THEN CASE m % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS a FROM l) SELECT count(a) AS labelled, count(*) FILTER (WHERE a) AS agreed, round(count(*) FILTER (WHERE a) / count(a), 6) AS rate FROM q")
def human_agreement(spark, sf_dir):
    """The last label of each investigation; one that says neither doesn't count."""
    k = F.col("o_orderkey")
    return op.agreement(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("investigation"), k.alias("seq"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("agrees")))


@query("WITH c AS (SELECT c_custkey AS candidate, c_mktsegment AS category FROM customer), t AS (SELECT DISTINCT c_mktsegment AS category, 'f' || (c_nationkey % 4) AS family FROM customer WHERE c_nationkey % 3 > 0), a AS (SELECT DISTINCT o_custkey AS candidate, 'f' || (o_orderkey % 4) AS family FROM orders), m AS (SELECT candidate, family FROM c JOIN t USING (category) EXCEPT SELECT * FROM a) SELECT candidate, string_agg(family, ',' ORDER BY family) AS missing FROM m GROUP BY 1")
def expectation_table(spark, sf_dir):
    """Decisive families that a candidate's category expects and nothing has answered."""
    c = table(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("f"), F.col("c_nationkey") % 4).alias("family"), (F.col("c_nationkey") % 3 > 0).alias("decisive")).distinct()
    answered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.concat(F.lit("f"), F.col("o_orderkey") % 4).alias("family"))
    return op.expectations(c.select(F.col("c_custkey").alias("candidate"), F.col("c_mktsegment").alias("category")), wanted, answered)


@query("WITH n AS (SELECT o_custkey % 40 AS incident, o_custkey AS entity, 's' || (o_custkey % 7) AS source, o_orderkey AS edge FROM orders) SELECT incident, count(DISTINCT entity) AS entities, count(DISTINCT edge) AS edges, count(DISTINCT source) FILTER (WHERE source IN ('s1', 's2')) AS blind, count(DISTINCT entity) <= 40 AND count(DISTINCT edge) <= 80 AS fits FROM n GROUP BY 1")
def search_space(spark, sf_dir):
    """How large an investigation's graph is and how many of its sources have gaps."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("incident"), F.col("o_custkey").alias("entity"), F.concat(F.lit("s"), F.col("o_custkey") % 7).alias("source"), F.col("o_orderkey").alias("edge"))
    return op.search_space(rows, rows, spark.createDataFrame([("s1",), ("s2",), ("s9",)], "source string"))


@query("WITH x AS (SELECT c_custkey AS id, c_custkey % 7 / 7 AS v FROM customer WHERE c_custkey % 5 > 0), y AS (SELECT c_custkey AS id, c_custkey % 5 / 5 AS v FROM customer WHERE c_custkey % 6 > 0) SELECT coalesce(x.id, y.id) AS id, x.v AS before, y.v AS after, CASE WHEN x.id IS NULL THEN 'new' WHEN y.id IS NULL THEN 'gone' WHEN abs(y.v - x.v) < 1e-9 THEN 'same' WHEN y.v > x.v THEN 'improved' ELSE 'worse' END AS movement FROM x FULL OUTER JOIN y ON x.id = y.id")
def audit_movement(spark, sf_dir):
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return op.audit_movement(c.where(i % 5 > 0).select(i.alias("id"), (i % 7 / 7).alias("v")), c.where(i % 6 > 0).select(i.alias("id"), (i % 5 / 5).alias("v")), "id", "v")


@query("SELECT DISTINCT p_brand AS category FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def uncovered_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category")
    return op.uncovered(p, p.where("p_size > 48"))


@query("WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, avg(c_acctbal) AS a, avg(CASE WHEN c_custkey % 2 = 0 THEN 1.0 END) AS b, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS m FROM customer GROUP BY 1), l AS (SELECT name, 'c_acctbal' AS metric, a AS v, n FROM f UNION ALL SELECT name, 'even', b, m FROM f WHERE m > 0) SELECT 'fixture' AS scope, name, metric, round(v, 6)::DOUBLE AS value, n FROM l UNION ALL SELECT 'corpus', '', metric, round(avg(v), 6)::DOUBLE, count(*) FROM l GROUP BY metric")
def report_rows(spark, sf_dir):
    """Metrics by fixture, and over the corpus with every fixture weighing alike."""
    c = table(spark, sf_dir, "customer").withColumn("even", F.when(F.col("c_custkey") % 2 == 0, 1.0))
    return op.report_rows(c, "c_nationkey", ["c_acctbal", "even"])


@query("WITH l AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 5 = 1), b AS (SELECT coalesce(l.id, f.id) AS id, l.id IS NOT NULL AS l, f.id IS NOT NULL AS f FROM l FULL OUTER JOIN f ON l.id = f.id), x AS (SELECT *, id % 6 = 0 AS x FROM b) SELECT count(*) FILTER (WHERE l AND NOT x) AS listed, count(*) FILTER (WHERE l AND x) AS excluded, count(*) FILTER (WHERE l AND f AND NOT x) AS matched, count(*) FILTER (WHERE l AND NOT f AND NOT x) AS missing, count(*) FILTER (WHERE NOT l AND NOT x) AS extra, round(count(*) FILTER (WHERE l AND f AND NOT x) / count(*) FILTER (WHERE l AND NOT x), 6) AS ratio FROM x")
def deploy_gaps(spark, sf_dir):
    """Coverage of deploys, without those that a rule excludes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    return op.deploy_gaps(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 1"), o.where("id % 6 = 0"), "id")
