"""Connector transforms over the star tables."""

from pyspark.sql import functions as F

from palimpsest.operators import connectors as op
from palimpsest.registry import query
from palimpsest.sources import model as m
from palimpsest.sources.model import table


@query(
    f"""WITH {m.A}, w AS (SELECT entity, event_id, lag(source) OVER x AS ps, source, lag(k % 3) OVER x AS pk, k % 3 AS nk, row_number() OVER x AS n FROM a WINDOW x AS (PARTITION BY entity ORDER BY event_id))
    SELECT entity, event_id, 'rollout' AS kind, ps AS old, source AS new FROM w WHERE n > 1 AND ps <> source UNION ALL SELECT entity, event_id, 'scaling', CAST(pk AS VARCHAR), CAST(nk AS VARCHAR) FROM w WHERE n > 1 AND pk <> nk"""
)
def snapshot_changes(spark, sf_dir):
    views = m.assertions(spark, sf_dir).withColumn("replicas", F.col("k") % 3)
    return op.snapshot_changes(views, "entity", ["event_id"], {"source": "rollout", "replicas": "scaling"})


@query("SELECT o_custkey, epoch_us(min(o_orderdate) FILTER (WHERE o_orderstatus = 'F')) AS completed, epoch_us(max(o_orderdate)) AS last_attempt, count(*) FILTER (WHERE o_orderstatus = 'P') AS unrecognised FROM orders GROUP BY 1")
def status_fold(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "pending").otherwise("?")
    out = op.status_fold(table(spark, sf_dir, "orders").withColumn("status", status), "o_custkey", "o_orderdate")
    return out.select("o_custkey", m.micros("completed").alias("completed"), m.micros("last_attempt").alias("last_attempt"), "unrecognised")


_POLLS = f"{m.A}, s AS (SELECT entity, CAST(floor(epoch(valid_from) / 21600) AS BIGINT) AS poll FROM a WHERE k < 20), p AS (SELECT DISTINCT CAST(floor(epoch(valid_from) / 21600) AS BIGINT) AS poll FROM a)"


@query(f"WITH {_POLLS}, l AS (SELECT entity, max(poll) AS valid_end FROM s GROUP BY 1) SELECT entity, valid_end, (SELECT count(*) FROM p WHERE p.poll > l.valid_end AND p.poll % 5 <> 0) AS missed FROM l WHERE (SELECT count(*) FROM p WHERE p.poll > l.valid_end AND p.poll % 5 <> 0) >= 4")
def silence_tracker(spark, sf_dir):
    poll = F.floor(F.unix_seconds("valid_from") / 21600).cast("long").alias("poll")
    a = m.assertions(spark, sf_dir)
    polls = a.select(poll).distinct().withColumn("complete", F.col("poll") % 5 != 0)
    return op.silence(polls, a.where("k < 20").select("entity", poll), 4)


@query(
    f"""WITH {m.A}, s AS (SELECT event_id, k, CASE WHEN k % 5 = 0 THEN ' svc' || (k % 7) ELSE '' END AS peer, CASE WHEN k % 3 = 1 THEN 'postgres' ELSE '' END AS db, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN 'db' || (k % 9) || '.shop.svc.cluster.local' ELSE 'api.vendor' || (k % 6) || '.com' END AS address,
    CASE k % 4 WHEN 0 THEN 'HTTPS' WHEN 1 THEN 'grpc' ELSE 'http' END AS scheme FROM a), r AS (SELECT *, CASE WHEN trim(peer) <> '' THEN 1 WHEN address IS NOT NULL AND (db <> '' OR lower(scheme) IN ('http', 'https')) THEN 2 ELSE 0 END AS rung FROM s)
    SELECT event_id, CASE rung WHEN 1 THEN 'otel.service.name' WHEN 2 THEN 'server.address' END AS namespace, CASE rung WHEN 1 THEN trim(peer) WHEN 2 THEN address END AS value, CASE rung WHEN 1 THEN trim(peer) WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'db' || (k % 9) ELSE 'vendor' || (k % 6) END END AS name,
    CASE rung WHEN 1 THEN db <> '' OR address IS NOT NULL WHEN 2 THEN true END AS external FROM r"""
)
def callee_resolution(spark, sf_dir):
    """A peer service, else a database's address, else an address over http; spans that address nothing give null."""
    k = F.col("k")
    peer, db = F.when(k % 5 == 0, F.concat(F.lit(" svc"), k % 7)).otherwise(""), F.when(k % 3 == 1, "postgres").otherwise("")
    address = F.when(k % 4 == 3, None).when(k % 2 == 0, F.concat(F.lit("db"), k % 9, F.lit(".shop.svc.cluster.local"))).otherwise(F.concat(F.lit("api.vendor"), k % 6, F.lit(".com")))
    scheme = F.when(k % 4 == 0, "HTTPS").when(k % 4 == 1, "grpc").otherwise("http")
    return m.assertions(spark, sf_dir).select("event_id", op.callee(peer, db, address, scheme).alias("c")).select("event_id", "c.*")


@query("SELECT r_name, n_name, s_suppkey, count(*) AS parts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3")
def exposure_chain(spark, sf_dir):
    rules = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("proxy"))
    proxies = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("proxy"), F.col("n_nationkey").alias("backend"))
    backends = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("backend"), F.col("s_suppkey").alias("service"))
    services = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("service")).agg(F.count(F.lit(1)).alias("parts"))
    return op.exposure(rules, proxies, backends, services).select("r_name", "n_name", F.col("service").alias("s_suppkey"), "parts")


@query(
    """WITH p AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'who' || c_custkey % 20 END AS who FROM customer)
    SELECT i AS c_custkey, CASE WHEN who = '' AND i % 3 <> 0 AND i % 5 <> 0 AND i % 7 <> 0 THEN 'UNSPECIFIED' WHEN who IN ('who1', 'who2', 'who3') THEN 'AUTOMATION' WHEN i % 3 = 0 THEN 'CONTROLLER' WHEN who IN ('who3', 'who5', 'who6', 'who7') THEN 'PERSON' WHEN i % 5 = 0 THEN 'VENDOR' ELSE 'UNKNOWN' END AS kind FROM p"""
)
def actor_kinds(spark, sf_dir):
    """The ladder over principals, of which some are listed, some are the platform's own, and some acts are a vendor's."""
    i = F.col("c_custkey")
    who = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("who"), i % 20))
    own = F.when(i % 3 == 0, F.array(F.lit("platform"))).otherwise(F.array().cast("array<string>"))
    kind = op.actor_kind(F.when(i % 2 == 0, who), F.when(i % 2 == 1, who), F.when(i % 7 == 0, "key").otherwise(""), own, F.lit(None).cast("boolean"), i % 5 == 0, ["who1", "who2", "who3"], ["who3", "who5", "who6", "who7"])
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"))


@query(
    """WITH l AS (SELECT p_brand AS source, CASE WHEN p_partkey % 5 <> 0 OR p_brand < 'Brand#3' THEN p_type END AS sha, CASE WHEN p_brand < 'Brand#5' OR p_size <= 40 THEN p_name END AS release, p_size > 40 AS error FROM part),
    s AS (SELECT source, count(sha) / count(*) AS sl, coalesce(count(sha) FILTER (WHERE error) / nullif(count(*) FILTER (WHERE error), 0), 1) AS se, count(release) / count(*) AS rl, coalesce(count(release) FILTER (WHERE error) / nullif(count(*) FILTER (WHERE error), 0), 1) AS re FROM l GROUP BY 1)
    SELECT source, CASE WHEN sl >= 0.95 AND se >= 0.95 THEN 'sha' WHEN rl >= 0.95 AND re >= 0.95 THEN 'release' ELSE 'none' END AS stamp FROM s"""
)
def version_stamp(spark, sf_dir):
    """Of each source of lines the first stamp that nearly all lines and nearly all error lines have."""
    lines = table(spark, sf_dir, "part").withColumn("sha", F.when((F.col("p_partkey") % 5 != 0) | (F.col("p_brand") < "Brand#3"), F.col("p_type"))).withColumn("release", F.when((F.col("p_brand") < "Brand#5") | (F.col("p_size") <= 40), F.col("p_name")))
    return op.stamp_verdict(lines.withColumnRenamed("p_brand", "source"), ["sha", "release"], F.col("p_size") > 40, "source")


@query("WITH r AS (SELECT o_orderkey AS release, o_orderdate AS at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 3 END AS back FROM orders) SELECT x.release, y.release AS credited FROM r x JOIN r y ON y.release = x.back WHERE y.at < x.at")
def rollback_credit(spark, sf_dir):
    k = F.col("o_orderkey")
    return op.rollback_credit(table(spark, sf_dir, "orders").select(k.alias("release"), F.col("o_orderdate").alias("at"), F.when(k % 7 == 0, k - 3).alias("rolled_back_from")))


_OBJ = """o AS (SELECT s_suppkey AS i, 'c' || (s_nationkey % 3) AS cluster, s_suppkey % 5 = 0 AS pool FROM supplier), w AS (SELECT i, cluster || '/ns' || (i % 4) || '/w' || i AS ref, cluster, CASE WHEN i % 3 > 0 THEN 'team' || (i % 6) END AS owner, CASE WHEN i % 4 > 0 THEN cluster || '/p' || (i % 10 // 5 * 5) END AS runs FROM o WHERE NOT pool)"""


def _objects(spark, sf_dir):
    i, text = F.col("s_suppkey"), lambda p, n: F.concat(F.lit(p), n)
    pool = i % 5 == 0
    return table(spark, sf_dir, "supplier").select(
        text("c", F.col("s_nationkey") % 3).alias("cluster"), F.when(pool, "pool").otherwise("workload").alias("kind"), F.when(pool, text("p", i)).otherwise(text("w", i)).alias("name"), text("ns", i % 4).alias("space"),
        F.when(~pool & (i % 3 > 0), text("team", i % 6)).alias("owner"), F.when(~pool & (i % 4 > 0), text("p", F.floor(i % 10 / 5) * 5)).alias("pool"), F.when(~pool, F.array(text("db", i % 7), text("db", i % 2))).alias("uses"),
    )


@query(f"WITH {_OBJ} SELECT DISTINCT cluster AS ref, 'CLUSTER' AS type FROM o WHERE pool UNION SELECT cluster || '/p' || i, 'NODE_POOL' FROM o WHERE pool UNION SELECT ref, 'WORKLOAD' FROM w UNION SELECT owner, 'OWNER' FROM w WHERE owner IS NOT NULL")
def object_nodes(spark, sf_dir):
    return op.objects_graph(_objects(spark, sf_dir))[0]


@query(f"WITH {_OBJ} SELECT ref AS src, runs AS dst, 'runs_on' AS type FROM w WHERE runs IS NOT NULL UNION SELECT ref, owner, 'owned_by' FROM w WHERE owner IS NOT NULL UNION SELECT ref, 'db' || (i % 7), 'depends_on' FROM w UNION SELECT ref, 'db' || (i % 2), 'depends_on' FROM w UNION SELECT cluster || '/p' || i, cluster, 'part_of' FROM o WHERE pool")
def object_edges(spark, sf_dir):
    """Where workloads run, who owns them and what they use."""
    return op.objects_graph(_objects(spark, sf_dir))[1]


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'r1=' || (p_size + 100 - p_size) ELSE CASE WHEN p_size % 100 > 0 THEN 'r1=' || p_size || ',' ELSE '' END || 'r2=' || (100 - p_size) END AS split FROM part")
def traffic_splits(spark, sf_dir):
    """Splits in one form, whatever their order, repeats and empty shares."""
    i, size = F.col("p_partkey"), F.col("p_size")
    t = lambda r, p: F.struct(F.lit(r).alias("revision"), p.alias("percent"))
    targets = F.when(i % 3 == 0, F.array(t("r1", 100 - size), t("r0", F.lit(0)), t("r1", size))).otherwise(F.array(t("r2", 100 - size), t("r1", size)))
    return table(spark, sf_dir, "part").select(i.alias("id"), op.traffic_split(targets).alias("split"))


_AUDIT = "e AS (SELECT o_orderkey % 400 AS operation, 's' || (o_custkey % 30) AS scope, o_orderdate AS tm, o_orderpriority AS actor FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1990-01-01'), i AS (SELECT operation, scope, max(tm) AS tm, arg_max(actor, (tm, actor)) AS actor FROM e GROUP BY 1, 2)"
_HELD = f"{_AUDIT}, c AS (SELECT c_custkey AS change, 's' || (c_custkey % 33) AS scope, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS f FROM customer), d AS (SELECT change, c.scope, tm, operation, actor, row_number() OVER (PARTITION BY change ORDER BY tm, operation, actor) AS n FROM c JOIN i ON i.scope = c.scope AND tm > f - INTERVAL 1 HOUR AND tm <= f + INTERVAL 40 DAY)"


def _audit(spark, sf_dir):
    k = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select((k % 400).alias("operation"), F.concat(F.lit("s"), F.col("o_custkey") % 30).alias("scope"), (k % 3 != 0).alias("last"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("actor"))
    return op.audit_index(entries, m.at("1990-01-01 00:00:00"))


def _held(spark, sf_dir):
    i = F.col("c_custkey")
    seen = m.at("1995-01-01 00:00:00") + F.make_dt_interval(days=(i % 900).cast("int"))
    changes = table(spark, sf_dir, "customer").select(i.alias("change"), F.concat(F.lit("s"), i % 33).alias("scope"), seen.alias("seen_from"), (seen + F.expr("INTERVAL 40 DAYS")).alias("seen_to"))
    return op.dated_or_held(changes, _audit(spark, sf_dir), 3600)


@query(f"WITH {_AUDIT} SELECT operation, scope, epoch_us(tm) AS at, actor FROM i")
def audit_index(spark, sf_dir):
    """The completion of each operation in each scope."""
    return _audit(spark, sf_dir).withColumn("at", m.micros("at"))


@query(f"WITH {_HELD} SELECT change, epoch_us(tm) AS at, operation FROM d WHERE n = 1")
def changes_dated(spark, sf_dir):
    """Changes seen between two polls, dated by an audited completion."""
    return _held(spark, sf_dir)[0].select("change", m.micros("at").alias("at"), "operation")


@query(f"WITH {_HELD} SELECT change FROM c WHERE change NOT IN (SELECT change FROM d)")
def changes_held(spark, sf_dir):
    """Changes that nothing dates are held."""
    return _held(spark, sf_dir)[1].select("change")


@query(f"WITH {_HELD} SELECT operation, scope FROM i WHERE (operation, scope) NOT IN (SELECT operation, scope FROM d WHERE n = 1)")
def audit_unconsumed(spark, sf_dir):
    return _held(spark, sf_dir)[2].select("operation", "scope")


@query(f"WITH {m.A}, s AS (SELECT entity, k // 25 AS uid, event_id AS poll FROM a), l AS (SELECT entity, uid, min(poll) AS first, max(poll) AS last FROM s GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first, uid) > 1 AS recreated FROM l")
def recreations(spark, sf_dir):
    return op.lifetimes(m.assertions(spark, sf_dir).select("entity", F.floor(F.col("k") / 25).alias("uid"), F.col("event_id").alias("poll")))


@query("WITH s AS (SELECT c_custkey AS entity, c_custkey * 10 AS e FROM customer WHERE c_custkey % 3 <> 0), d AS (SELECT o_custkey AS entity, max(o_orderkey) AS x FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT coalesce(s.entity, d.entity) AS entity, coalesce(x, e) AS valid_end, CASE WHEN x IS NULL THEN 'silence' ELSE 'deletion' END AS by FROM s FULL OUTER JOIN d ON s.entity = d.entity")
def deletion_overrides(spark, sf_dir):
    """An audited deletion gives the instant, else the silence does."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("entity"), (F.col("c_custkey") * 10).alias("valid_end"))
    return op.ended(c, table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("at")))


@query(
    f"""WITH {m.A}, v AS (SELECT entity, event_id, 't' || (k % 3) AS tier, CASE WHEN k % 2 = 0 THEN 'on' END AS flag, lag(event_id) OVER w AS p, 't' || (lag(k) OVER w % 3) AS ot, CASE WHEN lag(k) OVER w % 2 = 0 THEN 'on' END AS fo FROM a WINDOW w AS (PARTITION BY entity ORDER BY event_id))
    SELECT entity, event_id, 'tier' AS name, ot AS old, tier AS new FROM v WHERE p IS NOT NULL AND ot <> tier UNION ALL SELECT entity, event_id, 'flag', fo, flag FROM v WHERE p IS NOT NULL AND fo IS DISTINCT FROM flag"""
)
def settings_diff(spark, sf_dir):
    """Settings that came, went or changed between two views of an instance."""
    k = F.col("k")
    bag = F.map_filter(F.create_map(F.lit("tier"), F.concat(F.lit("t"), k % 3), F.lit("flag"), F.when(k % 2 == 0, "on")), lambda _, v: v.isNotNull())
    return op.settings_diff(m.assertions(spark, sf_dir).withColumn("settings", bag), "entity", "event_id", "settings")


@query("WITH s AS (SELECT c_custkey AS service, c_custkey % 4 = 0 AS sure, c_custkey % 50 AS n FROM customer), i AS (SELECT s_suppkey AS instance FROM supplier) SELECT service, instance, sure AND n = instance AS certain FROM s JOIN i ON contains('mainorders' || n || 'dsn', 'orders' || instance)")
def derived_dependencies(spark, sf_dir):
    """Dependencies that a configured connection proves, and those that a variable's name suggests."""
    i = F.col("c_custkey")
    services = table(spark, sf_dir, "customer").select(i.alias("service"), F.when(i % 4 == 0, F.array(F.concat(F.lit("p:r:orders"), i % 50))).otherwise(F.array().cast("array<string>")).alias("connections"), F.array(F.concat(F.lit("MAIN_ORDERS_"), i % 50, F.lit("_DSN")), F.lit("HOME")).alias("variables"))
    k = F.col("s_suppkey")
    instances = table(spark, sf_dir, "supplier").select(k.alias("instance"), F.concat(F.lit("p:r:orders"), k).alias("connection"), F.concat(F.lit("orders-"), k).alias("name"))
    return op.derived_dependencies(services, instances)


_REL = "r AS (SELECT 'repo' || (o_custkey % 9) AS repository, o_orderpriority AS environment, o_orderkey % 500 AS release, min(date_trunc('day', o_orderdate)) AS completed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2, 3)"


def _releases(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("repo"), F.col("o_custkey") % 9).alias("repository"), F.col("o_orderpriority").alias("environment"), (F.col("o_orderkey") % 500).alias("release"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("pending").alias("status"), F.date_trunc("day", "o_orderdate").alias("at"))
    return op.releases(rows)


@query(f"WITH {_REL} SELECT repository, environment, release, epoch_us(completed) AS completed, count(*) OVER (PARTITION BY repository, environment, completed) > 1 AS tied FROM r")
def release_read(spark, sf_dir):
    """Releases at their first success, and which of an environment tie."""
    return _releases(spark, sf_dir).withColumn("completed", m.micros("completed"))


@query(f"WITH {_REL}, u AS (SELECT 'repo' || i AS repository, CASE WHEN i % 2 = 0 THEN '1-URGENT' END AS e, 't' || i || j AS target FROM range(0, 7) a(i), range(0, 2) b(j)), f AS (SELECT DISTINCT r.repository, environment, release, target FROM r JOIN u ON u.repository = r.repository AND (e IS NULL OR e = environment)) SELECT * FROM f UNION ALL SELECT repository, environment, release, NULL FROM r WHERE release NOT IN (SELECT release FROM f)")
def release_targets(spark, sf_dir):
    """Rules that split a repository's release into its targets."""
    rules = spark.createDataFrame([(f"repo{i}", "1-URGENT" if i % 2 == 0 else None, None, f"t{i}{j}") for i in range(7) for j in range(2)], "repository string, environment string, workflow string, target string")
    rows = _releases(spark, sf_dir).select("repository", "environment", "release").withColumn("workflow", F.lit("deploy"))
    return op.release_targets(rows, rules).drop("workflow")


_DEP = "d AS (SELECT o_orderkey AS deployment, o_custkey % 20 AS project, CASE o_orderstatus WHEN 'F' THEN 'PROMOTED' WHEN 'O' THEN 'READY' ELSE 'ERROR' END AS state, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'preview' ELSE 'production' END AS target, o_orderkey % 90 AS commit, o_orderdate AS tm FROM orders)"


def _deployments(spark, sf_dir):
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "PROMOTED").when(F.col("o_orderstatus") == "O", "READY").otherwise("ERROR")
    return op.promotions(table(spark, sf_dir, "orders").select(k.alias("deployment"), (F.col("o_custkey") % 20).alias("project"), state.alias("state"), F.when(k % 5 == 0, None).when(k % 5 == 1, "preview").otherwise("production").alias("target"), (k % 90).alias("commit"), F.col("o_orderdate").alias("at")))


@query(f"WITH {_DEP} SELECT deployment, project, lag(deployment) OVER (PARTITION BY project, commit ORDER BY tm, deployment) AS rolled_back_to FROM d WHERE state = 'PROMOTED' AND target = 'production'")
def promotions(spark, sf_dir):
    """Promoted production deployments, with the earlier one of the same commit."""
    return _deployments(spark, sf_dir)[0].select("deployment", "project", "rolled_back_to")


@query(f"WITH {_DEP} SELECT CASE WHEN state <> 'PROMOTED' THEN 'state ' || lower(state) ELSE 'target ' || coalesce(target, 'none') END AS reason, count(*) AS n FROM d WHERE state <> 'PROMOTED' OR target IS DISTINCT FROM 'production' GROUP BY 1")
def promotions_excluded(spark, sf_dir):
    return _deployments(spark, sf_dir)[1]


@query("SELECT o_orderkey AS event, 'svc' || (o_custkey % 12) AS service, CASE o_orderkey % 4 WHEN 0 THEN 'rollout' WHEN 1 THEN 'flag' WHEN 2 THEN 'rollback' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) END AS commit, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || (o_orderkey % 7) END AS version FROM orders WHERE o_custkey % 12 < 8")
def change_events(spark, sf_dir):
    """Change events of known services, their kinds by title and their deploy keys by tags."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Deployed web").when(k % 4 == 1, "toggled Flag x").when(k % 4 == 2, "rollback of deployed web").otherwise("note")
    commit = F.when(k % 3 == 0, F.substring(F.sha2(k.cast("string"), 256), 1, 40)).otherwise("abc1234")
    tags = F.array_compact(F.array(F.concat(F.lit("service:svc"), F.col("o_custkey") % 12), F.concat(F.lit("git.commit.sha:"), commit), F.when(k % 2 == 0, F.concat(F.lit("version:v"), k % 7)), F.lit("plain")))
    events = table(spark, sf_dir, "orders").select(k.alias("event"), title.alias("title"), tags.alias("tags"))
    return op.change_events(events, [f"svc{i}" for i in range(8)], {"rollback": "rollback", "deployed": "rollout", "flag": "flag"})


@query("WITH t AS (SELECT l_suppkey, l_shipdate % 1 AS x, l_partkey % 6 AS name, sum(l_quantity) AS h FROM (SELECT l_suppkey, 0 AS l_shipdate, l_partkey, l_quantity FROM lineitem) q GROUP BY 1, 2, 3) SELECT l_suppkey, arg_max(name, (h, name)) AS dominant, arg_min(name, (-h, name)) AS busiest FROM t GROUP BY 1")
def busiest_operation(spark, sf_dir):
    """The version with the most hits, of equals the largest; and the operation with the most, of equals the smallest."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 6).alias("name"), F.col("l_quantity").alias("hits"))
    return op.busiest(rows, "l_suppkey", "name", "hits", True).withColumnRenamed("name", "dominant").join(op.busiest(rows, "l_suppkey", "name", "hits", False).withColumnRenamed("name", "busiest"), "l_suppkey")


@query("WITH l AS (SELECT user_id AS source, user_id % 3 <> 0 OR event_id % 9 = 0 AS s, user_id % 4 <> 0 AND event_id % 3 > 0 AS v FROM events), g AS (SELECT source, count(*) AS n, avg(CASE WHEN s THEN 1 ELSE 0 END) AS s, avg(CASE WHEN v THEN 1 ELSE 0 END) AS v FROM l GROUP BY 1) SELECT source, CASE WHEN n < 60 THEN 'quiet' WHEN s < 0.5 THEN 'anonymous' WHEN v < 0.5 THEN 'unstamped' ELSE 'stamped' END AS verdict FROM g")
def log_source_verdicts(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    lines = table(spark, sf_dir, "events").select(u.alias("source"), F.when((u % 3 != 0) | (e % 9 == 0), "svc").alias("service"), F.when((u % 4 != 0) & (e % 3 > 0), "v1").alias("version"))
    return op.log_sources(lines, 60)


@query(
    """WITH r AS (SELECT 'v' || (o_custkey % 6) AS vendor, CASE WHEN o_orderkey % 3 > 0 THEN 'N' || (o_orderkey % 40) END AS notice, 'p' || (o_custkey % 4) AS product, CASE o_orderkey % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'confirmed' ELSE 'announced' END AS state, o_orderkey % 10 AS start, o_orderkey % 10 + 5 AS fin, o_orderkey AS read_at, CASE WHEN o_orderkey % 8 = 1 THEN 'v' || (o_custkey % 6) || '/N' || (o_orderkey % 39) END AS of FROM orders),
    k AS (SELECT *, vendor || '/' || coalesce(notice, substr(sha256(vendor || '|' || product || '|' || start), 1, 16)) AS ref FROM r WHERE vendor <> 'v5'), l AS (SELECT ref, arg_max(vendor, read_at) AS vendor, arg_max(state, read_at) AS state, arg_max(start, read_at) AS start, arg_max(fin, read_at) AS fin, max(of) AS of FROM k GROUP BY 1), b AS (SELECT of AS ref, min(ref) AS superseded_by FROM l WHERE of IS NOT NULL GROUP BY 1)
    SELECT l.ref, vendor, CASE WHEN superseded_by IS NOT NULL AND state <> 'cancelled' THEN 'superseded' ELSE state END AS state, start, fin AS end, superseded_by FROM l LEFT JOIN b ON b.ref = l.ref"""
)
def vendor_notices(spark, sf_dir):
    """Vendors' notices by their last read: announced, confirmed, cancelled or superseded."""
    k, v = F.col("o_orderkey"), F.concat(F.lit("v"), F.col("o_custkey") % 6)
    reads = table(spark, sf_dir, "orders").select(
        v.alias("vendor"), F.when(k % 3 > 0, F.concat(F.lit("N"), k % 40)).alias("notice"), F.concat(F.lit("p"), F.col("o_custkey") % 4).alias("product"), F.when(k % 4 == 0, "cancelled").when(k % 4 == 1, "confirmed").otherwise("announced").alias("state"),
        (k % 10).alias("start"), (k % 10 + 5).alias("end"), k.alias("read_at"), F.when(k % 8 == 1, F.concat(v, F.lit("/N"), k % 39)).alias("supersedes"),
    )
    return op.notices(reads, spark.createDataFrame([(f"v{i}",) for i in range(5)], "vendor string"))


@query("SELECT c_custkey AS channel, 'sev' || (c_custkey % 4) AS severity, '2024-03-0' || (1 + c_custkey % 9) AS date, 'shop-' || c_custkey AS slug, 'px_' || substr(sha256(unhex('{0}') || unhex(sha256(unhex('{1}') || CAST(c_name AS BLOB)))), 1, 16) AS declared_by FROM customer WHERE c_custkey % 5 > 1".format(*("".join(f"{b ^ p:02x}" for b in b"k".ljust(64, b"\0")) for p in (0x5C, 0x36))))
def channel_declarations(spark, sf_dir):
    """Channels that declare an incident, by whom as a pseudonym; bots and other names don't."""
    i = F.col("c_custkey")
    name = F.when(i % 5 == 0, F.concat(F.lit("general-"), i)).otherwise(F.concat(F.lit("Sev"), i % 4, F.lit("-2024-03-0"), 1 + i % 9, F.lit("-shop-"), i))
    found = op.declared_incidents(table(spark, sf_dir, "customer").select(i.alias("channel"), name.alias("name"), F.col("c_name").alias("creator"), (i % 5 == 1).alias("bot")), b"k")
    return found.withColumn("date", F.col("date").cast("string"))


@query("WITH n AS (SELECT DISTINCT o_custkey AS document, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 10 END AS entity FROM orders WHERE o_custkey % 3 = 0), o AS (SELECT DISTINCT o_custkey AS document, o_orderkey % 8 AS entity FROM orders WHERE o_custkey IN (SELECT document FROM n)), m AS (SELECT * FROM n WHERE entity IS NOT NULL) SELECT coalesce(m.document, o.document) AS document, coalesce(m.entity, o.entity) AS entity, CASE WHEN o.document IS NULL THEN 'link' WHEN m.document IS NULL THEN 'retract' ELSE 'keep' END AS action FROM m FULL OUTER JOIN o ON m.document = o.document AND m.entity = o.entity")
def page_links(spark, sf_dir):
    """Links that a page gained, lost or kept; pages that weren't read are left alone."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), k)
    return op.link_changes(o.where("document % 3 = 0").select("document", F.when(k % 4 == 0, None).otherwise(k % 10).alias("entity")), o.select("document", (k % 8).alias("entity")))


@query("WITH b AS (SELECT conv_id AS document, turn AS seq, turn % 3 = 0 AS heading, role || turn AS text FROM conversations), s AS (SELECT *, max(CASE WHEN heading THEN seq END) OVER (PARTITION BY document ORDER BY seq) AS at_ FROM b) SELECT document, coalesce(max(CASE WHEN heading THEN text END), '') AS label, 0 AS part, string_agg(CASE WHEN NOT heading THEN text END, chr(10) ORDER BY seq) AS text FROM s GROUP BY document, at_ HAVING count(*) FILTER (WHERE NOT heading) > 0")
def page_sections(spark, sf_dir):
    """Blocks gathered under their headings."""
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("seq"), (F.col("turn") % 3 == 0).alias("heading"), F.concat("role", F.col("turn")).alias("text"))
    return op.page_sections(blocks)


_WIN = f"{m.A}, w AS (SELECT entity AS service, 'v' || (event_id // 300) AS version, CASE WHEN k % 4 > 0 THEN 'u' || (k % 9) END AS callee, CAST(floor(epoch(valid_from) / 86400) AS BIGINT) AS win FROM a)"


@query(
    f"""WITH {_WIN}, v AS (SELECT service, win, max(version) AS version FROM w GROUP BY 1, 2), l AS (SELECT *, lag(version) OVER (PARTITION BY service ORDER BY win) AS old FROM v) SELECT unnest(['node', 'claim']) AS kind, service AS key, '' AS detail, min(win) AS win FROM w GROUP BY service
    UNION ALL SELECT 'edge', service, callee, min(win) FROM w WHERE callee IS NOT NULL GROUP BY service, callee UNION ALL SELECT 'rollout', service, old || '>' || version, win FROM l WHERE old <> version UNION ALL SELECT DISTINCT 'checkpoint', '', '', win FROM w"""
)
def window_events(spark, sf_dir):
    """What a service's windows tell: nodes, claims, edges, rollouts and checkpoints."""
    k = F.col("k")
    rows = m.assertions(spark, sf_dir).select(F.col("entity").alias("service"), F.concat(F.lit("v"), F.floor(F.col("event_id") / 300)).alias("version"), F.when(k % 4 > 0, F.concat(F.lit("u"), k % 9)).alias("callee"), F.floor(F.unix_seconds("valid_from") / 86400).alias("window"))
    return op.window_events(rows).withColumnRenamed("window", "win")


@query("SELECT p, 'zone=z' || (i % 2) AS group_key, string_agg(DISTINCT 'db/n' || i, ',' ORDER BY 'db/n' || i) AS watches FROM (SELECT n_nationkey % 5 AS p, n_nationkey AS i FROM nation) q GROUP BY 1, 2")
def alert_policies(spark, sf_dir):
    i = F.col("n_nationkey")
    resource = F.struct(F.lit("db").alias("type"), F.create_map(F.lit("name"), F.concat(F.lit("n"), i), F.lit("zone"), F.concat(F.lit("z"), i % 2)).alias("labels"))
    policies = table(spark, sf_dir, "nation").groupBy((i % 5).alias("policy")).agg(F.collect_list(resource).alias("resources")).withColumn("group_by", F.array(F.lit("zone")))
    return op.alert_policies(policies).withColumnRenamed("policy", "p")
