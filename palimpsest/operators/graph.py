"""Graph reads over as-of slices. Foci come as rows (focus, node), so one job answers one focus or all of them.

Loops run once a hop, and hops are bounded: nothing iterates over data on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOPS, PER_HOP, TOTAL, MOST_HOPS = 2, 50, 500, 8
#: Requests a second from which the classes 1 to 5 begin.
WEIGHT_BOUNDS = (0.0, 0.1, 1.0, 10.0, 100.0)
#: Parts of a score.
TEMPORAL, TOPOLOGICAL, TRAFFIC, TAU = 0.50, 0.35, 0.15, 1800


def weight_class(rate: Column) -> Column:
    """0 without traffic; 1 to 5 by requests a second."""
    return reduce(lambda c, i: c.when(rate > WEIGHT_BOUNDS[i], i + 1), range(4, 0, -1), F.when(rate.isNull() | (rate <= 0), 0)).otherwise(1)


def selected(edges: DataFrame, types: list[str] | None = None, min_weight: int | None = None) -> DataFrame:
    if types:
        edges = edges.where(F.col("type").isin(types))
    return edges if min_weight is None else edges.where(F.coalesce("weight_class", F.lit(0)) >= min_weight)


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """anchor, neighbour and the edge's columns, one row for each way an edge may be walked. upstream walks from dst to src."""
    down = edges.withColumn("anchor", F.col("src")).withColumn("neighbour", F.col("dst"))
    up = edges.withColumn("anchor", F.col("dst")).withColumn("neighbour", F.col("src"))
    return {"downstream": down, "upstream": up}.get(direction) or down.unionByName(up)


def _strongest() -> list[Column]:
    return [F.desc_nulls_last("weight_class"), F.asc("neighbour"), F.asc("type"), F.asc("edge_id")]


def subgraph(edges: DataFrame, foci: DataFrame, hops: int = HOPS, direction: str = "both", per_hop: int = PER_HOP, total: int = TOTAL) -> tuple[DataFrame, DataFrame]:
    """(focus, node, hop) and (focus, hop, edge_id, src, dst, type, weight_class) by breadth-first search.

    Each frontier node follows its `per_hop` strongest edges: weight descending, then neighbour, type, edge. Of a
    focus the first `total` edges by (hop, edge) stay.
    """
    if not 0 < hops <= MOST_HOPS:
        raise ValueError(f"hops must be 1 to {MOST_HOPS}")
    walk = steps(edges, direction)
    seen = foci.select("focus", "node", F.lit(0).alias("hop"))
    frontier, found = seen, []
    for hop in range(1, hops + 1):
        near = frontier.select("focus", F.col("node").alias("anchor")).join(walk, "anchor")
        kept = near.withColumn("_n", F.row_number().over(Window.partitionBy("focus", "anchor").orderBy(*_strongest()))).where(F.col("_n") <= per_hop)
        found.append(kept.select("focus", F.lit(hop).alias("hop"), "edge_id", "src", "dst", "type", "weight_class"))
        frontier = kept.select("focus", F.col("neighbour").alias("node")).distinct().join(seen.select("focus", "node"), ["focus", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    every = reduce(DataFrame.unionByName, found)
    once = every.groupBy("focus", "edge_id", "src", "dst", "type", "weight_class").agg(F.min("hop").alias("hop"))
    first = Window.partitionBy("focus").orderBy("hop", "edge_id")
    capped = once.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= total).drop("_n")
    return seen, capped


def reach(edges: DataFrame, foci: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """focus, node, hop (shortest), weight: over shortest paths the largest class on the path."""
    walk = steps(edges, direction).groupBy("anchor", "neighbour").agg(F.max(F.coalesce("weight_class", F.lit(0))).alias("w"))
    seen = foci.select("focus", "node", F.lit(0).alias("hop"), F.lit(0).alias("weight"))
    frontier = seen
    for hop in range(1, hops + 1):
        near = frontier.select("focus", F.col("node").alias("anchor"), "weight").join(walk, "anchor")
        frontier = near.groupBy("focus", F.col("neighbour").alias("node")).agg(F.max(F.greatest("weight", "w")).alias("weight")).join(seen.select("focus", "node"), ["focus", "node"], "left_anti").select("focus", "node", F.lit(hop).alias("hop"), "weight")
        seen = seen.unionByName(frontier)
    return seen


def temporal_weight(seconds_before: Column, tau: float = TAU) -> Column:
    """How near a change is: decays with tau before the reference, twice as fast and from one half after it."""
    return F.when(seconds_before >= 0, F.exp(-seconds_before / tau)).otherwise(0.5 * F.exp(seconds_before / (tau / 2)))


def rank(candidates: DataFrame, reference: Column, cap: int, tau: float = TAU) -> DataFrame:
    """Add temporal, topological, traffic, score and rank to (focus, change_id, start, hop, weight, attached)."""
    dt = (F.unix_micros(reference) - F.unix_micros("start")) / 1e6
    hop, weight = F.when(F.col("attached"), F.col("hop")).otherwise(cap + 1), F.when(F.col("attached"), F.col("weight")).otherwise(0)
    out = candidates.withColumn("temporal", temporal_weight(dt, tau)).withColumn("topological", 1.0 / (1 + hop)).withColumn("traffic", (1 + weight) / 6.0)
    out = out.withColumn("score", F.round(TEMPORAL * F.col("temporal") + TOPOLOGICAL * F.col("topological") + TRAFFIC * F.col("traffic"), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("focus").orderBy(F.desc("score"), "change_id")))


def formula(tau: float = TAU) -> str:
    return f"score = {TEMPORAL:.2f}*temporal(tau={tau:g}s) + {TOPOLOGICAL:.2f}/(1+hops) + {TRAFFIC:.2f}*(1+weight)/6"


def candidates(changes: DataFrame, reached: DataFrame, after: Column, until: Column) -> DataFrame:
    """Changes that start in (after, until], with hop and weight for each focus that reaches their target; once, unattached and without focus, if none does."""
    within = changes.where((F.col("start") > after) & (F.col("start") <= until))
    own = ["focus", "change_id", "target", "start", "observed_from", "k", "hop", "weight", "attached"]
    near = within.join(reached.withColumnRenamed("node", "target"), "target").withColumn("attached", F.lit(True)).select(*own)
    loose = within.join(reached.select(F.col("node").alias("target")).distinct(), "target", "left_anti")
    nothing = {"focus": F.lit(None).cast("string"), "hop": F.lit(None).cast("int"), "weight": F.lit(None).cast("int"), "attached": F.lit(False)}
    return near.unionByName(loose.withColumns(nothing).select(*own))


def diff_nodes(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    from palimpsest.operators.relational import keyed_diff

    return keyed_diff(before, after, key, content).select(key, "change")


def current_edges(slice_: DataFrame) -> DataFrame:
    """Of the edges in one slice with equal (src, dst, type) the later one: valid start, then id."""
    best = slice_.groupBy("src", "dst", "type").agg(F.max_by(F.struct("edge_id", "weight_class"), F.struct("valid_from", "edge_id")).alias("_e"))
    return best.select("src", "dst", "type", "_e.edge_id", "_e.weight_class")


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """src, dst, type, change, weight_before, weight_after."""
    a = current_edges(before).select("src", "dst", "type", F.coalesce("weight_class", F.lit(-1)).alias("weight_before"))
    b = current_edges(after).select("src", "dst", "type", F.coalesce("weight_class", F.lit(-1)).alias("weight_after"))
    change = F.when(F.col("weight_before").isNull(), "added").when(F.col("weight_after").isNull(), "removed").when(F.col("weight_before") != F.col("weight_after"), "changed")
    return a.join(b, ["src", "dst", "type"], "full_outer").withColumn("change", change).where("change IS NOT NULL")


def delta(before: DataFrame, after: DataFrame, key: str, props: str) -> DataFrame:
    """key, name, old, new: the entries of map column `props` that differ."""
    a = before.select(key, F.explode(props).alias("name", "old"))
    b = after.select(key, F.explode(props).alias("name", "new"))
    return a.join(b, [key, "name"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def truncation(edges: DataFrame, foci: DataFrame, hops: int = HOPS, direction: str = "both", per_hop: int = PER_HOP, total: int = TOTAL) -> DataFrame:
    """focus, reason of the subgraphs that are cut: per_hop_cap if a frontier node has more edges than are followed, else total_cap."""
    nodes, _ = subgraph(edges, foci, hops, direction, per_hop, 1 << 30)
    degree = steps(edges, direction).groupBy(F.col("anchor").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
    wide = nodes.where(F.col("hop") < hops).join(degree.where(F.col("_d") > per_hop), "node").select("focus", F.lit("per_hop_cap").alias("reason"))
    _, kept = subgraph(edges, foci, hops, direction, per_hop, total + 1)
    many = kept.groupBy("focus").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total).select("focus", F.lit("total_cap").alias("reason"))
    return wide.unionByName(many).groupBy("focus").agg(F.min("reason").alias("reason"))


def paths(links: DataFrame, foci: DataFrame, hops: int, best: int = 101) -> DataFrame:
    """focus, node, hops, weight (smallest class on the path), path: simple paths up to `hops` over links (focus, anchor, neighbour, w).

    After each hop every (focus, node) keeps its `best` paths: weight descending, then path. That bounds what grows
    from a node, whatever its degree, and never loses the heaviest path, which is the first of its own list.
    """
    front = foci.select("focus", "node", F.array("node").alias("path"), F.lit(None).cast("int").alias("weight"))
    out = []
    for hop in range(1, hops + 1):
        grown = front.withColumnRenamed("node", "anchor").join(links, ["focus", "anchor"]).where(~F.array_contains("path", F.col("neighbour")))
        grown = grown.select("focus", F.col("neighbour").alias("node"), F.concat("path", F.array("neighbour")).alias("path"), F.least(F.coalesce("weight", "w"), "w").alias("weight"))
        order = Window.partitionBy("focus", "node").orderBy(F.desc("weight"), F.array_join("path", "/"))
        front = grown.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= best).drop("_n")
        out.append(front.withColumn("hops", F.lit(hop)))
    return reduce(DataFrame.unionByName, out)


#: Whom a side of a blast radius names, and how edges are walked to them: dependents lie upstream.
SIDES = (("downstream", "upstream"), ("upstream", "downstream"))


def _links(edges: DataFrame, foci: DataFrame, hops: int, direction: str, per_hop: int, total: int) -> DataFrame:
    """The directed steps (focus, anchor, neighbour, w) of each focus's subgraph, one for each type of edge."""
    _, kept = subgraph(current_edges(edges), foci, hops, direction, per_hop, total)
    return steps(kept, direction).select("focus", "anchor", "neighbour", F.coalesce("weight_class", F.lit(0)).alias("w"))


def impact_side(edges: DataFrame, nodes: DataFrame, foci: DataFrame, direction: str, hops: int = 3, per_hop: int = PER_HOP, total: int = TOTAL, most: int = 100) -> DataFrame:
    """focus, node, weight, hop, route, others: of each node that directed steps reach, and that `nodes` (entity) has, the
    heaviest path, its shortest distance, and how many other paths there are (`most` reads as that many or more).

    The heaviest path is the one whose weakest step is heaviest, then the shorter, then the first by its nodes.
    """
    every = paths(_links(edges, foci, hops, direction, per_hop, total), foci, hops, most + 1).withColumn("route", F.array_join("path", "/"))
    group = Window.partitionBy("focus", "node")
    ranked = every.withColumn("_n", F.row_number().over(group.orderBy(F.desc("weight"), "hops", "route"))).withColumn("others", F.least(F.count(F.lit(1)).over(group) - 1, F.lit(most)))
    found = ranked.withColumn("hop", F.min("hops").over(group)).where("_n = 1").select("focus", "node", "weight", "hop", "route", "others")
    return found.join(nodes.select(F.col("entity").alias("node")).distinct(), "node", "left_semi").select("focus", "node", "weight", "hop", "route", "others")


def impact(edges: DataFrame, nodes: DataFrame, foci: DataFrame, hops: int = 3, per_hop: int = PER_HOP, total: int = TOTAL) -> DataFrame:
    """Both sides of impact_side() with `side` and `truncated`, the reason for which a side's subgraph is cut, or null."""
    out = []
    for side, direction in SIDES:
        cut = truncation(current_edges(edges), foci, hops, direction, per_hop, total).withColumnRenamed("reason", "truncated")
        out.append(impact_side(edges, nodes, foci, direction, hops, per_hop, total).withColumn("side", F.lit(side)).join(cut, "focus", "left"))
    return out[0].unionByName(out[1])


def shortest_route(edges: DataFrame, foci: DataFrame, hops: int, direction: str = "downstream") -> DataFrame:
    """focus, node, hops, route: the first path by (length, path) along directed edges."""
    every = paths(_links(edges, foci, hops, direction, 1 << 30, 1 << 30), foci, hops).withColumn("route", F.array_join("path", "/"))
    return every.groupBy("focus", "node").agg(F.min(F.struct("hops", "route")).alias("_r")).select("focus", "node", "_r.hops", "_r.route")


def neighbourhood(before: DataFrame, after: DataFrame, foci: DataFrame, hops: int = HOPS, direction: str = "both", per_hop: int = PER_HOP, total: int = TOTAL) -> DataFrame:
    """focus, node, in_before, in_after: the nodes that either slice's walk reaches."""
    a, b = (subgraph(e, foci, hops, direction, per_hop, total)[0].select("focus", "node").withColumn(side, F.lit(True)) for e, side in ((before, "in_before"), (after, "in_after")))
    no = F.lit(False)
    return a.join(b, ["focus", "node"], "full_outer").select("focus", "node", F.coalesce("in_before", no).alias("in_before"), F.coalesce("in_after", no).alias("in_after"))


def diff_focus_nodes(hood: DataFrame, before: DataFrame, after: DataFrame, content: list[str]) -> DataFrame:
    """focus, node, change: nodes that came to the neighbourhood, left it, or have other content. before, after: entity and content."""
    a = hood.where("in_before").join(before.select(F.col("entity").alias("node"), F.struct(*content).alias("_a")), "node").select("focus", "node", "_a")
    b = hood.where("in_after").join(after.select(F.col("entity").alias("node"), F.struct(*content).alias("_b")), "node").select("focus", "node", "_b")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, ["focus", "node"], "full_outer").select("focus", "node", change.alias("change")).where("change IS NOT NULL")


def diff_focus_edges(hood: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """focus, src, dst, type, change, weight_before, weight_after of the edges between two nodes of a neighbourhood."""
    found, ends = diff_edges(before, after), hood.select("focus", "node")
    return found.join(ends.withColumnRenamed("node", "src"), "src").join(ends.withColumnRenamed("node", "dst"), ["focus", "dst"]).select("focus", "src", "dst", "type", "change", "weight_before", "weight_after")


def diff_reach(before: DataFrame, after: DataFrame, foci: DataFrame, hops: int = HOPS, margin: int = 1, direction: str = "both") -> DataFrame:
    """reach() over both slices, `margin` hops beyond the neighbourhood: where changes are looked for."""
    if not 0 <= margin <= 4:
        raise ValueError("margin must be 0 to 4")
    same = current_edges(before.unionByName(after))
    return reach(same, foci, hops + margin, direction)


def with_keys(ranked: DataFrame, keys: DataFrame, observed: Column) -> DataFrame:
    """ranked changes with `keys`, the sorted distinct namespace=value that sources gave for the change up to an instant.

    keys: change_id, namespace, value, observed_at.
    """
    own = keys.where(F.col("observed_at") <= observed).groupBy("change_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "namespace", "value"))).alias("keys"))
    return ranked.join(own, "change_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def change_targets(ranked: DataFrame, before: DataFrame, after: DataFrame, content: list[str]) -> DataFrame:
    """focus, entity, read_at (t2, or t1 where it was gone by then) and content of the targets of ranked changes; what neither instant has is left out.

    ranked: focus, target.
    """
    own = ranked.select("focus", F.col("target").alias("entity")).distinct()
    a, b = (side.select("entity", F.struct(*content).alias(name)) for side, name in ((before, "_a"), (after, "_b")))
    both = own.join(b, "entity", "left").join(a, "entity", "left").where(F.col("_a").isNotNull() | F.col("_b").isNotNull())
    read = F.when(F.col("_b").isNotNull(), "t2").otherwise("t1")
    return both.select("focus", "entity", read.alias("read_at"), F.coalesce("_b", "_a").alias("_c")).select("focus", "entity", "read_at", "_c.*")
