"""Graph reads: one focus where the SQL stays readable, all foci where it can."""

from pyspark.sql import functions as F

from palimpsest.operators import graph as op
from palimpsest.operators import temporal
from palimpsest.registry import query
from palimpsest.sources import model as m


def _live(name: str, instant: str) -> str:
    known = f"observed_from <= TIMESTAMP '{m.KNOWN}' AND (observed_to IS NULL OR TIMESTAMP '{m.KNOWN}' < observed_to)"
    return f"{name} AS (SELECT * FROM e WHERE valid_from <= TIMESTAMP '{instant}' AND TIMESTAMP '{instant}' < valid_to AND {known})"


_STEP = "w AS (SELECT src AS anchor, dst AS neighbour, * FROM s UNION ALL SELECT dst, src, * FROM s)"
_MAXED = "x AS (SELECT anchor, neighbour, max(coalesce(weight_class, 0)) AS w FROM w GROUP BY 1, 2)"


def _slice(spark, sf_dir, instant=m.T1):
    return temporal.as_of(m.edges(spark, sf_dir), m.at(instant), m.at(m.KNOWN))


def _foci(spark, sf_dir, only=None):
    ids = m.assertions(spark, sf_dir).select(F.col("entity").alias("focus")).distinct()
    return (ids.where(F.col("focus") == only) if only else ids).withColumn("node", F.col("focus"))


@query("SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 0 WHEN value > 100 THEN 5 WHEN value > 10 THEN 4 WHEN value > 1 THEN 3 WHEN value > 0.1 THEN 2 ELSE 1 END AS class FROM events")
def weight_class(spark, sf_dir):
    return m.table(spark, sf_dir, "events").select("event_id", op.weight_class(F.col("value")).alias("class"))


_BFS = """h1 AS (SELECT DISTINCT f.focus, w.neighbour AS node FROM f JOIN w ON w.anchor = f.focus WHERE w.neighbour <> f.focus),
 h2 AS (SELECT DISTINCT h1.focus, w.neighbour AS node FROM h1 JOIN w ON w.anchor = h1.node WHERE w.neighbour <> h1.focus AND NOT EXISTS (SELECT 1 FROM h1 y WHERE y.focus = h1.focus AND y.node = w.neighbour))"""
_ALL_FOCI = "f AS (SELECT DISTINCT entity AS focus FROM a)"


@query(f"WITH {m.E}, {_live('s', m.T1)}, {_STEP}, {_ALL_FOCI}, {_BFS} SELECT focus, focus AS node, 0 AS hop FROM f UNION ALL SELECT focus, node, 1 FROM h1 UNION ALL SELECT focus, node, 2 FROM h2")
def subgraph_2hop(spark, sf_dir):
    """Every entity's two-hop neighbourhood in one job, without caps."""
    nodes, _ = op.subgraph(_slice(spark, sf_dir), _foci(spark, sf_dir), 2, per_hop=1 << 30, total=1 << 30)
    return nodes


@query(
    f"""WITH {m.E}, {_live('s', m.T1)}, {_STEP}, {_ALL_FOCI},
    k1 AS (SELECT * FROM (SELECT f.focus, w.*, row_number() OVER (PARTITION BY f.focus, w.anchor ORDER BY weight_class DESC NULLS LAST, neighbour, type, edge_id) AS n FROM f JOIN w ON w.anchor = f.focus) q WHERE n <= 3),
    h1 AS (SELECT DISTINCT focus, neighbour AS node FROM k1 WHERE neighbour <> focus),
    k2 AS (SELECT * FROM (SELECT h1.focus, w.*, row_number() OVER (PARTITION BY h1.focus, w.anchor ORDER BY weight_class DESC NULLS LAST, neighbour, type, edge_id) AS n FROM h1 JOIN w ON w.anchor = h1.node) q WHERE n <= 3),
    b AS (SELECT focus, edge_id, min(hop) AS hop FROM (SELECT focus, edge_id, 1 AS hop FROM k1 UNION ALL SELECT focus, edge_id, 2 FROM k2) q GROUP BY 1, 2)
    SELECT focus, edge_id, hop FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY hop, edge_id) AS n FROM b) q WHERE n <= 10"""
)
def subgraph_capped(spark, sf_dir):
    _, edges = op.subgraph(_slice(spark, sf_dir), _foci(spark, sf_dir), 2, per_hop=3, total=10)
    return edges.select("focus", "edge_id", "hop")


@query(f"WITH {m.E}, {_live('s', m.T1)} SELECT edge_id, src, dst FROM s WHERE type = 'calls' AND coalesce(weight_class, 0) >= 3")
def edge_filters(spark, sf_dir):
    return op.selected(_slice(spark, sf_dir), ["calls"], 3).select("edge_id", "src", "dst")


@query(
    f"""WITH {m.E}, {_live('s', m.T1)}, {_STEP}, {_MAXED}, {_ALL_FOCI}, r1 AS (SELECT f.focus, x.neighbour AS node, max(x.w) AS weight FROM f JOIN x ON x.anchor = f.focus WHERE x.neighbour <> f.focus GROUP BY 1, 2),
    r2 AS (SELECT r1.focus, x.neighbour AS node, max(greatest(r1.weight, x.w)) AS weight FROM r1 JOIN x ON x.anchor = r1.node WHERE x.neighbour <> r1.focus AND NOT EXISTS (SELECT 1 FROM r1 y WHERE y.focus = r1.focus AND y.node = x.neighbour) GROUP BY 1, 2)
    SELECT focus, focus AS node, 0 AS hop, 0 AS weight FROM f UNION ALL SELECT focus, node, 1, weight FROM r1 UNION ALL SELECT focus, node, 2, weight FROM r2"""
)
def reachability(spark, sf_dir):
    return op.reach(_slice(spark, sf_dir), _foci(spark, sf_dir), 2)


def _nodes(spark, sf_dir, instant):
    return temporal.as_of(m.versions(spark, sf_dir), m.at(instant), m.at(m.KNOWN))


_N = "(SELECT * FROM v WHERE valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR TIMESTAMP '{0}' < valid_to) AND observed_from <= TIMESTAMP '" + m.KNOWN + "' AND (observed_to IS NULL OR TIMESTAMP '" + m.KNOWN + "' < observed_to))"


@query(
    f"""WITH {m.V}, x AS {_N.format(m.T1)}, y AS {_N.format(m.T2)}
    SELECT coalesce(x.entity, y.entity) AS entity, CASE WHEN x.entity IS NULL THEN 'added' WHEN y.entity IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM x FULL OUTER JOIN y ON x.entity = y.entity WHERE x.entity IS NULL OR y.entity IS NULL OR x.state <> y.state OR x.value <> y.value"""
)
def diff_nodes(spark, sf_dir):
    return op.diff_nodes(_nodes(spark, sf_dir, m.T1), _nodes(spark, sf_dir, m.T2), "entity", ["state", "value"])


_CURRENT = "(SELECT src, dst, type, weight_class FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY valid_from DESC, edge_id DESC) AS n FROM {}) q WHERE n = 1)"


@query(
    f"""WITH {m.E}, {_live('s', m.T1)}, {_live('t', m.T2)}, x AS {_CURRENT.format('s')}, y AS {_CURRENT.format('t')},
    j AS (SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, coalesce(x.type, y.type) AS type, CASE WHEN x.src IS NOT NULL THEN coalesce(x.weight_class, -1) END AS weight_before,
    CASE WHEN y.src IS NOT NULL THEN coalesce(y.weight_class, -1) END AS weight_after FROM x FULL OUTER JOIN y ON x.src = y.src AND x.dst = y.dst AND x.type = y.type)
    SELECT *, CASE WHEN weight_before IS NULL THEN 'added' WHEN weight_after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE weight_before IS DISTINCT FROM weight_after"""
)
def diff_edges(spark, sf_dir):
    return op.diff_edges(_slice(spark, sf_dir, m.T1), _slice(spark, sf_dir, m.T2))


@query(
    f"""WITH {m.V}, x AS {_N.format(m.T1)}, y AS {_N.format(m.T2)}, p AS (SELECT entity, unnest(['state', 'source', 'even']) AS name, unnest([state, source, CAST(k % 2 AS VARCHAR)]) AS old FROM x),
    q AS (SELECT entity, unnest(['state', 'source', 'even']) AS name, unnest([state, source, CAST(k % 2 AS VARCHAR)]) AS new FROM y)
    SELECT coalesce(p.entity, q.entity) AS entity, coalesce(p.name, q.name) AS name, old, new FROM p FULL OUTER JOIN q ON p.entity = q.entity AND p.name = q.name WHERE old IS DISTINCT FROM new"""
)
def property_delta(spark, sf_dir):
    def bag(rows):
        return rows.select("entity", F.create_map(F.lit("state"), "state", F.lit("source"), "source", F.lit("even"), (F.col("k") % 2).cast("string")).alias("props"))

    return op.delta(bag(_nodes(spark, sf_dir, m.T1)), bag(_nodes(spark, sf_dir, m.T2)), "entity", "props")


_REACHED = f"""WITH {m.E}, c AS (SELECT event_id AS change_id, entity AS target, valid_from AS start, observed_from, k FROM a WHERE state = 'error'), {_live('s', m.T1)}, {_STEP}, {_MAXED}, f AS (SELECT 'u8' AS focus),
 r1 AS (SELECT f.focus, x.neighbour AS node, max(x.w) AS weight FROM f JOIN x ON x.anchor = f.focus WHERE x.neighbour <> f.focus GROUP BY 1, 2),
 r AS (SELECT focus, focus AS node, 0 AS hop, 0 AS weight FROM f UNION ALL SELECT focus, node, 1, weight FROM r1), i AS (SELECT * FROM c WHERE start > TIMESTAMP '{m.T1}' AND start <= TIMESTAMP '{m.T2}')"""


def _candidates(spark, sf_dir):
    near = op.reach(_slice(spark, sf_dir), _foci(spark, sf_dir, "u8"), 1)
    return op.candidates(m.changes(spark, sf_dir), near, m.at(m.T1), m.at(m.T2))


@query(_REACHED + " SELECT i.change_id, r.hop, r.weight, r.node IS NOT NULL AS attached FROM i LEFT JOIN r ON i.target = r.node")
def change_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("change_id", "hop", "weight", "attached")


@query(
    _REACHED
    + f""", j AS (SELECT i.change_id, r.node IS NOT NULL AS attached, coalesce(r.hop, 2) AS hop, coalesce(r.weight, 0) AS weight, (epoch_us(TIMESTAMP '{m.T2}') - epoch_us(i.start)) / 1e6 AS dt FROM i LEFT JOIN r ON i.target = r.node)
    SELECT change_id, round(0.5 * exp(-dt / 86400) + 0.35 / (1 + hop) + 0.15 * (1 + weight) / 6.0, 6) AS score FROM j"""
)
def rank_changes(spark, sf_dir):
    """Changes of two days ranked for one focus, a day as the time scale."""
    return op.rank(_candidates(spark, sf_dir), m.at(m.T2), 1, 86400).select("change_id", "score")


@query(_REACHED + " SELECT change_id, CASE WHEN k % 9 = 0 THEN 'announced_in_future' WHEN observed_from > start + INTERVAL 60 MINUTE THEN 'stale' ELSE 'kept' END AS decision FROM i")
def excluded_announced(spark, sf_dir):
    """What the ranker leaves out and why: announced for later, or known more than an hour late."""
    late = F.unix_micros("observed_from") - F.unix_micros("start") > 3_600_000_000
    decision = F.when(F.col("k") % 9 == 0, "announced_in_future").when(late, "stale").otherwise("kept")
    within = m.changes(spark, sf_dir).where((F.col("start") > m.at(m.T1)) & (F.col("start") <= m.at(m.T2)))
    return within.select("change_id", decision.alias("decision"))


def _paths(anchor: str, neighbour: str, foci: str = "SELECT 'u8' AS focus", hops: int = 3) -> str:
    """Simple directed paths over the edges that speak for their (src, dst, type); `seen` are the entities with a version."""
    return f"""WITH RECURSIVE {m.E}, {_live('s', m.T1)}, x AS (SELECT {anchor} AS anchor, {neighbour} AS neighbour, coalesce(weight_class, 0) AS w FROM {_CURRENT.format('s')} c), seen AS (SELECT DISTINCT entity FROM {_N.format(m.T1)} q),
 p AS (SELECT focus, focus AS node, [focus] AS path, NULL::INTEGER AS weight, 0 AS hops FROM ({foci}) f
 UNION ALL SELECT p.focus, x.neighbour, list_append(p.path, x.neighbour), least(coalesce(p.weight, x.w), x.w), p.hops + 1 FROM p JOIN x ON x.anchor = p.node WHERE p.hops < {hops} AND NOT list_contains(p.path, x.neighbour)),
 z AS (SELECT *, array_to_string(path, '/') AS route FROM p WHERE hops > 0)"""


_HEAVIEST = ", y AS (SELECT *, row_number() OVER (PARTITION BY focus, node ORDER BY weight DESC, hops, route) AS n, least(count(*) OVER (PARTITION BY focus, node) - 1, 100) AS others, min(hops) OVER (PARTITION BY focus, node) AS hop FROM z WHERE node IN (SELECT entity FROM seen)) SELECT focus, node, weight, hop, route, others FROM y WHERE n = 1"


@query(_paths("dst", "src") + _HEAVIEST)
def impact_downstream(spark, sf_dir):
    """Who depends on one entity: edges walked from their end to their start."""
    return op.impact_side(_slice(spark, sf_dir), _nodes(spark, sf_dir, m.T1), _foci(spark, sf_dir, "u8"), "upstream", 3, 1 << 30, 1 << 30)


@query(_paths("src", "dst") + _HEAVIEST)
def impact_upstream(spark, sf_dir):
    """What one entity depends on."""
    return op.impact_side(_slice(spark, sf_dir), _nodes(spark, sf_dir, m.T1), _foci(spark, sf_dir, "u8"), "downstream", 3, 1 << 30, 1 << 30)


@query(_paths("src", "dst") + ", y AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, route) AS n FROM z) SELECT focus, node, hops, route FROM y WHERE n = 1")
def shortest_route(spark, sf_dir):
    return op.shortest_route(_slice(spark, sf_dir), _foci(spark, sf_dir, "u8"), 3)


@query(_paths("dst", "src", "SELECT DISTINCT entity AS focus FROM a", 2) + _HEAVIEST)
def impact_all_foci(spark, sf_dir):
    """Who depends on each entity, two steps far, for all entities in one job."""
    return op.impact_side(_slice(spark, sf_dir), _nodes(spark, sf_dir, m.T1), _foci(spark, sf_dir), "upstream", 2, 1 << 30, 1 << 30)


@query()
def impact_capped_all_foci(spark, sf_dir):
    """Both sides of every entity's blast radius, three steps far, fifty edges a node and five hundred in all, with what was cut."""
    return op.impact(_slice(spark, sf_dir), _nodes(spark, sf_dir, m.T1), _foci(spark, sf_dir))


def _degrees(instant: str) -> str:
    return f"WITH {m.E}, {_live('s', instant)}, {_STEP}, f AS (SELECT DISTINCT entity AS focus FROM a), d AS (SELECT anchor, count(*) AS n FROM w GROUP BY 1)"


@query(
    _degrees(m.T1)
    + """, h1 AS (SELECT DISTINCT k.focus, k.neighbour AS node FROM (SELECT f.focus, w.*, row_number() OVER (PARTITION BY f.focus ORDER BY weight_class DESC NULLS LAST, neighbour, type, edge_id) AS n FROM f JOIN w ON w.anchor = f.focus) k WHERE n <= 2 AND neighbour <> focus),
    r AS (SELECT focus, focus AS node FROM f UNION ALL SELECT * FROM h1) SELECT focus, 'per_hop_cap' AS reason FROM r JOIN d ON d.anchor = r.node GROUP BY focus HAVING max(d.n) > 2"""
)
def subgraph_truncation(spark, sf_dir):
    """Which two-hop subgraphs are cut, and why, when two edges a node are followed."""
    return op.truncation(_slice(spark, sf_dir), _foci(spark, sf_dir), 2, per_hop=2, total=1 << 20)


def _hood(name: str) -> str:
    """Nodes within one step of u8 in slice `name`."""
    return f"SELECT 'u8' AS node UNION SELECT dst FROM {name} WHERE src = 'u8' UNION SELECT src FROM {name} WHERE dst = 'u8'"


_DIFF = f"WITH {m.E}, {_live('s', m.T1)}, {_live('t', m.T2)}, hx AS ({_hood('s')}), hy AS ({_hood('t')}), h AS (SELECT * FROM hx UNION SELECT * FROM hy), vx AS {_N.format(m.T1)}, vy AS {_N.format(m.T2)}, x AS (SELECT entity, state, value FROM vx JOIN hx ON node = entity), y AS (SELECT entity, state, value FROM vy JOIN hy ON node = entity)"


def _around(spark, sf_dir):
    before, after = _slice(spark, sf_dir), _slice(spark, sf_dir, m.T2)
    return op.neighbourhood(before, after, _foci(spark, sf_dir, "u8"), 1, per_hop=1 << 30, total=1 << 30), before, after


@query(_DIFF + " SELECT 'u8' AS focus, coalesce(x.entity, y.entity) AS node, CASE WHEN x.entity IS NULL THEN 'added' WHEN y.entity IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL OUTER JOIN y ON x.entity = y.entity WHERE x.entity IS NULL OR y.entity IS NULL OR x.state <> y.state OR x.value <> y.value")
def diff_focus(spark, sf_dir):
    """What came to, left or changed in one entity's neighbourhood between two instants."""
    hood, _, _ = _around(spark, sf_dir)
    return op.diff_focus_nodes(hood, _nodes(spark, sf_dir, m.T1), _nodes(spark, sf_dir, m.T2), ["state", "value"])


@query(
    _DIFF
    + f""", a1 AS {_CURRENT.format('s')}, b1 AS {_CURRENT.format('t')}, j AS (SELECT 'u8' AS focus, coalesce(p.src, q.src) AS src, coalesce(p.dst, q.dst) AS dst, coalesce(p.type, q.type) AS type, CASE WHEN p.src IS NOT NULL THEN coalesce(p.weight_class, -1) END AS weight_before,
    CASE WHEN q.src IS NOT NULL THEN coalesce(q.weight_class, -1) END AS weight_after FROM a1 p FULL OUTER JOIN b1 q ON p.src = q.src AND p.dst = q.dst AND p.type = q.type)
    SELECT *, CASE WHEN weight_before IS NULL THEN 'added' WHEN weight_after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE weight_before IS DISTINCT FROM weight_after AND src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)"""
)
def diff_focus_edges(spark, sf_dir):
    return op.diff_focus_edges(*_around(spark, sf_dir))


@query(_DIFF + f" SELECT DISTINCT 'u8' AS focus, a.entity, CASE WHEN q.entity IS NOT NULL THEN 't2' ELSE 't1' END AS read_at, coalesce(q.state, p.state) AS state FROM a LEFT JOIN vx p ON p.entity = a.entity LEFT JOIN vy q ON q.entity = a.entity WHERE a.state = 'error' AND a.valid_from > TIMESTAMP '{m.T1}' AND a.valid_from <= TIMESTAMP '{m.T2}' AND (p.entity IS NOT NULL OR q.entity IS NOT NULL)")
def change_targets(spark, sf_dir):
    """The targets of the window's changes as they were at its end, or at its start if they were gone by then."""
    ranked = m.changes(spark, sf_dir).where((F.col("start") > m.at(m.T1)) & (F.col("start") <= m.at(m.T2))).withColumn("focus", F.lit("u8"))
    return op.change_targets(ranked, _nodes(spark, sf_dir, m.T1), _nodes(spark, sf_dir, m.T2), ["state"])


@query(
    _REACHED + """, k AS (SELECT event_id AS change_id, 'deploy.release=v' || (k % 9) AS key FROM a WHERE k % 3 = 0 AND observed_from <= TIMESTAMP '2024-01-11 12:00:00' UNION SELECT event_id, 'deploy.commit_sha=' || md5(CAST(k % 4 AS VARCHAR)) FROM a WHERE k % 3 < 2 AND observed_from <= TIMESTAMP '2024-01-11 12:00:00')
    SELECT i.change_id, coalesce(string_agg(key, ';' ORDER BY key), '') AS keys FROM i LEFT JOIN k USING (change_id) GROUP BY 1"""
)
def correlation_keys(spark, sf_dir):
    """The cross-source keys that each change carries, as known at an instant; one that two sources gave is told once."""
    a = m.assertions(spark, sf_dir)
    own = [F.col("event_id").alias("change_id"), F.col("observed_from").alias("observed_at")]
    release = a.where("k % 3 = 0").select(*own, F.lit("deploy.release").alias("namespace"), F.concat(F.lit("v"), F.col("k") % 9).alias("value"))
    commit = a.where("k % 3 < 2").select(*own, F.lit("deploy.commit_sha").alias("namespace"), F.md5((F.col("k") % 4).cast("string")).alias("value"))
    within = m.changes(spark, sf_dir).where((F.col("start") > m.at(m.T1)) & (F.col("start") <= m.at(m.T2)))
    found = op.with_keys(within, release.unionByName(commit).unionByName(release), m.at("2024-01-11 12:00:00"))
    return found.select("change_id", F.array_join("keys", ";").alias("keys"))


_KINDS = "CASE k % 3 WHEN 0 THEN 'logs' WHEN 1 THEN 'metrics' ELSE 'traces' END"


@query(
    f"""WITH {m.V}, x AS {_N.format(m.T1)}, p AS (SELECT DISTINCT entity, {_KINDS} AS kind, 'svc=' || entity || ',type=' || state AS selector FROM x)
    SELECT entity, string_agg(kind || ':' || selector, ';' ORDER BY kind, selector) AS pointers FROM p GROUP BY entity"""
)
def pointers_by_kind(spark, sf_dir):
    kind = F.when(F.col("k") % 3 == 0, "logs").when(F.col("k") % 3 == 1, "metrics").otherwise("traces")
    selector = F.concat(F.lit("svc="), "entity", F.lit(",type="), "state")
    rows = _nodes(spark, sf_dir, m.T1).select("entity", F.struct(kind.alias("kind"), selector.alias("selector")).alias("p"))
    listed = F.transform(F.array_sort(F.collect_set("p")), lambda p: F.concat(p["kind"], F.lit(":"), p["selector"]))
    return rows.groupBy("entity").agg(F.array_join(listed, ";").alias("pointers"))


@query(f"WITH {m.V} SELECT event_id, state, row_number() OVER (ORDER BY observed_from, valid_from, event_id) AS position FROM v WHERE entity IN ('u8', 'u9')")
def node_history(spark, sf_dir):
    """All versions of an entity and of one merged into it, by observed start."""
    from pyspark.sql.window import Window

    own = m.versions(spark, sf_dir).where(F.col("entity").isin("u8", "u9"))  # one entity's history
    return own.select("event_id", "state", F.row_number().over(Window.orderBy("observed_from", "valid_from", "event_id")).alias("position"))


@query(f"WITH {m.E}, {_live('s', m.T1)}, {_live('t', m.T2)}, x AS {_CURRENT.format('s')}, y AS {_CURRENT.format('t')} SELECT x.src, x.dst FROM x LEFT JOIN y ON x.src = y.src AND x.dst = y.dst AND x.type = y.type WHERE x.type = 'calls' AND (y.src IS NULL OR coalesce(y.weight_class, -1) < coalesce(x.weight_class, -1))")
def fallen_edges(spark, sf_dir):
    """Calls that are gone or whose class has fallen."""
    found = op.diff_edges(_slice(spark, sf_dir, m.T1), _slice(spark, sf_dir, m.T2)).where("type = 'calls'")
    return found.where("change = 'removed' OR (change = 'changed' AND weight_after < weight_before)").select("src", "dst")
