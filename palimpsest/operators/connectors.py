"""Connector transforms: payloads with their previous state become events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import short_host


def snapshot_changes(views: DataFrame, key: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """One row a field that differs from the key's previous view: key, order columns, kind (of the field), old, new."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lag(c).over(w).cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c, kind in fields.items()))
    own = views.select(key, *order, pairs.alias("_p"), F.row_number().over(w).alias("_n")).where("_n > 1")
    return own.select(key, *order, F.explode("_p").alias("p")).where(~F.col("p.old").eqNullSafe(F.col("p.new"))).select(key, *order, "p.*")


def status_fold(statuses: DataFrame, deployment: str, at: str) -> DataFrame:
    """deployment, completed (earliest success), last_attempt, unrecognised."""
    known = ("success", "failure", "pending", "inactive")
    return statuses.groupBy(deployment).agg(
        F.min(F.when(F.col("status") == "success", F.col(at))).alias("completed"), F.max(at).alias("last_attempt"), F.count_if(~F.col("status").isin(*known)).alias("unrecognised")
    )


def silence(polls: DataFrame, sightings: DataFrame, after: int) -> DataFrame:
    """Entities unseen in the last `after` complete polls: entity, valid_end (the last poll that saw them), missed.

    polls: poll, complete; sightings: entity, poll. A partial poll counts for nothing.
    """
    last = sightings.groupBy("entity").agg(F.max("poll").alias("valid_end"))
    # For every poll how many complete ones came after it: one row a poll, joined by equality.
    every = polls.select("poll", "complete").unionByName(last.select(F.col("valid_end").alias("poll"), F.lit(False).alias("complete"))).groupBy("poll").agg(F.max(F.coalesce("complete", F.lit(False)).cast("int")).alias("_c"))
    later = Window.orderBy(F.desc("poll")).rowsBetween(Window.unboundedPreceding, -1)
    missed = every.select(F.col("poll").alias("valid_end"), F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("missed")).where(F.col("missed") >= after)
    return last.join(missed, "valid_end").select("entity", "valid_end", "missed")


def callee(peer: Column, db: Column, address: Column, scheme: Column) -> Column:
    """namespace, value, name, external of whom a span called; null where nothing is addressed.

    A peer service comes first (external if it also has a database or an address), then a database with an address,
    then an address over http or https.
    """
    peer, db, address, scheme = (F.trim(F.coalesce(c, F.lit(""))) for c in (peer, db, address, scheme))
    own = F.struct(F.lit("otel.service.name").alias("namespace"), peer.alias("value"), peer.alias("name"), ((db != "") | (address != "")).alias("external"))
    host = F.struct(F.lit("server.address").alias("namespace"), address.alias("value"), F.coalesce(F.nullif(short_host(address), F.lit("")), address).alias("name"), F.lit(True).alias("external"))
    return F.when(peer != "", own).when((address != "") & ((db != "") | F.lower(scheme).isin("http", "https")), host)


def exposure(rules: DataFrame, proxies: DataFrame, backends: DataFrame, services: DataFrame) -> DataFrame:
    """Which rule exposes which service: rule to proxy to backend to service."""
    return rules.join(proxies, "proxy").join(backends, "backend").join(services, "service")


def actor_kind(email: Column, subject: Column, key: Column, first_parties: Column, third_party: Column, vendor: Column, automation: list[str], people: list[str]) -> Column:
    """Who acted, by a ladder and never by how a name looks: unspecified without evidence, then a listed pipeline, the
    platform's own principal, a listed person, the vendor of an event, else unknown.

    first_parties: array of principals; third_party, vendor: booleans; automation and people: the configured lists.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    principal = F.when(text(email) != "", text(email)).otherwise(text(subject))
    platform, vendor = F.coalesce(F.size(first_parties) > 0, F.lit(False)), F.coalesce(vendor, F.lit(False))
    nothing = (principal == "") & (text(key) == "") & ~platform & ~F.coalesce(third_party, F.lit(False)) & ~vendor
    listed = lambda names: principal.isin(*names) if names else F.lit(False)
    return F.when(nothing, "UNSPECIFIED").when(listed(automation), "AUTOMATION").when(platform, "CONTROLLER").when(listed(people), "PERSON").when(vendor, "VENDOR").otherwise("UNKNOWN")


def stamp_verdict(lines: DataFrame, candidates: list[str], error: Column, by: str, share: float = 0.95) -> DataFrame:
    """by, stamp: the first candidate column set on `share` of all its lines and of its error lines."""
    aggs = []
    for c in candidates:
        aggs += [F.avg(F.col(c).isNotNull().cast("double")).alias(f"_l_{c}"), F.avg(F.when(error, F.col(c).isNotNull().cast("double"))).alias(f"_e_{c}")]
    pick = F.coalesce(*(F.when((F.col(f"_l_{c}") >= share) & (F.coalesce(f"_e_{c}", F.lit(1.0)) >= share), F.lit(c)) for c in candidates), F.lit("none"))
    return lines.groupBy(by).agg(*aggs).select(by, pick.alias("stamp"))


def rollback_credit(releases: DataFrame) -> DataFrame:
    """release, credited: the change that a rollback names as rolled back from."""
    named = releases.select(F.col("release").alias("_r"), F.col("at").alias("_at"))
    return releases.where("rolled_back_from IS NOT NULL").join(named, F.col("rolled_back_from") == F.col("_r")).where("_at < at").select("release", F.col("_r").alias("credited"))


def objects_graph(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a cluster's objects: cluster, kind (pool, workload), name, space, owner, pool, uses (array of refs).

    Nodes: ref, type. A workload runs on its pool and is owned by its owner; a pool belongs to the cluster; a workload
    depends on what it uses. Refs are cluster/space/name, or cluster/pool.
    """
    ref = lambda *parts: F.concat_ws("/", *parts)
    pools = objects.where("kind = 'pool'").select(F.explode(F.array(F.struct(ref("cluster", "name").alias("ref"), F.lit("NODE_POOL").alias("type")), F.struct(F.col("cluster").alias("ref"), F.lit("CLUSTER").alias("type")))).alias("n"))
    work = objects.where("kind = 'workload'").withColumn("ref", ref("cluster", "space", "name"))
    nodes = pools.unionByName(work.select(F.explode(F.array_compact(F.array(F.struct("ref", F.lit("WORKLOAD").alias("type")), F.when(F.col("owner").isNotNull(), F.struct(F.col("owner").alias("ref"), F.lit("OWNER").alias("type")))))).alias("n")))
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    own = F.array_compact(F.array(F.when(F.col("pool").isNotNull(), edge(F.col("ref"), ref("cluster", "pool"), "runs_on")), F.when(F.col("owner").isNotNull(), edge(F.col("ref"), F.col("owner"), "owned_by"))))
    uses = F.transform(F.array_distinct(F.coalesce("uses", F.array().cast("array<string>"))), lambda u: edge(F.col("ref"), u, "depends_on"))
    edges = work.select(F.explode(F.concat(own, uses)).alias("e")).unionByName(objects.where("kind = 'pool'").select(edge(ref("cluster", "name"), F.col("cluster"), "part_of").alias("e")))
    return nodes.select("n.*").distinct(), edges.select("e.*").distinct()


def traffic_split(targets: Column) -> Column:
    """A traffic split (array of revision, percent) in one form: shares of equal revisions summed, empty ones gone, by revision, as text."""
    names = F.array_sort(F.array_distinct(F.transform(F.filter(targets, lambda t: t["percent"] > 0), lambda t: t["revision"])))
    share = lambda n: F.aggregate(F.filter(targets, lambda t: t["revision"] == n), F.lit(0).cast("long"), lambda s, t: s + t["percent"].cast("long"))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), share(n).cast("string"))), ",")


def audit_index(entries: DataFrame, stale: Column) -> DataFrame:
    """operation, scope, at, actor of the completed operations: of each the last entry that says so, if it isn't older than `stale`.

    entries: operation, scope, last (it completes the operation), at, actor.
    """
    done = entries.where(F.col("last") & (F.col("at") >= stale))
    return done.groupBy("operation", "scope").agg(F.max(F.struct("at", "actor")).alias("e")).select("operation", "scope", "e.at", "e.actor")


def dated_or_held(changes: DataFrame, audit: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dated, held, unconsumed): a change (change, scope, seen_from, seen_to) is dated by the first completion in its scope
    between the polls that show it, up to `seconds` before the first; without one it is held. A completion that dates none is left."""
    early = F.col("seen_from") - F.make_interval(secs=F.lit(seconds))
    met = changes.join(audit, "scope").where((F.col("at") > early) & (F.col("at") <= F.col("seen_to")))
    dated = met.groupBy("change", "scope").agg(F.min(F.struct("at", "operation", "actor")).alias("e")).select("change", "scope", "e.at", "e.operation", "e.actor")
    return dated, changes.join(dated.select("change"), "change", "left_anti"), audit.join(dated.select("operation", "scope"), ["operation", "scope"], "left_anti")


def lifetimes(sightings: DataFrame) -> DataFrame:
    """entity, uid, first, last, recreated: each uid of an entity is a life of its own; one that follows another was recreated."""
    lives = sightings.groupBy("entity", "uid").agg(F.min("poll").alias("first"), F.max("poll").alias("last"))
    return lives.withColumn("recreated", F.lag("uid").over(Window.partitionBy("entity").orderBy("first", "uid")).isNotNull())


def ended(silent: DataFrame, deletions: DataFrame) -> DataFrame:
    """entity, valid_end, by: an audited deletion (entity, at) gives the instant, else the silence (entity, valid_end)."""
    last = deletions.groupBy("entity").agg(F.max("at").alias("_at"))
    both = silent.join(last, "entity", "full_outer")
    return both.select("entity", F.coalesce("_at", "valid_end").alias("valid_end"), F.when(F.col("_at").isNotNull(), "deletion").otherwise("silence").alias("by"))


def settings_diff(views: DataFrame, key: str, order: str, settings: str) -> DataFrame:
    """key, order, name, old, new: the entries of a settings map that differ from the key's previous view; a first view changes nothing."""
    w = Window.partitionBy(key).orderBy(order)
    own = views.withColumn("_old", F.lag(settings).over(w)).where(F.col("_old").isNotNull())
    names = F.array_union(F.map_keys("_old"), F.map_keys(settings))
    pairs = F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at("_old", n).alias("old"), F.try_element_at(F.col(settings), n).alias("new")))
    return own.select(key, order, F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p")).select(key, order, "p.*")


def derived_dependencies(services: DataFrame, instances: DataFrame) -> DataFrame:
    """service, instance, certain: a service that names an instance's connection depends on it for certain; one whose variable is named after it, perhaps.

    services: service, connections (array), variables (array of names); instances: instance, connection, name.
    """
    from palimpsest.operators.rules import folded, inside

    sure = services.select("service", F.explode("connections").alias("connection")).join(instances, "connection").select("service", "instance").distinct()
    named = inside(instances.select("instance", folded(F.col("name")).alias("_name")), "_name", services.select("service", F.explode("variables").alias("_v")).select("service", folded(F.col("_v")).alias("_v")).distinct(), "_v").select("service", "instance").distinct()
    return sure.withColumn("certain", F.lit(True)).unionByName(named.join(sure, ["service", "instance"], "left_anti").withColumn("certain", F.lit(False)))


def releases(statuses: DataFrame) -> DataFrame:
    """repository, environment, release, completed, tied: the releases that succeeded, each at its first success; tied if another of the environment did at the same instant."""
    done = statuses.where("status = 'success'").groupBy("repository", "environment", "release").agg(F.min("at").alias("completed"))
    return done.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("repository", "environment", "completed")) > 1)


def release_targets(released: DataFrame, rules: DataFrame) -> DataFrame:
    """released with target, one row a target: rules (repository, environment, workflow, target) apply where what they state agrees; null states nothing.

    A monorepo's release with several targets becomes several changes; one without any stays, with a null target.
    """
    r = rules.withColumnsRenamed({"environment": "_e", "workflow": "_w"})
    joined = released.join(r, "repository", "left").where(F.col("target").isNull() | ((F.col("_e").isNull() | (F.col("_e") == F.col("environment"))) & (F.col("_w").isNull() | (F.col("_w") == F.col("workflow")))))
    found = joined.where("target IS NOT NULL").select(*released.columns, "target").distinct()
    return found.unionByName(released.join(found.select("release").distinct(), "release", "left_anti").withColumn("target", F.lit(None).cast("string")))


def promotions(deployments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, excluded): deployments (deployment, project, state, target, commit, at) that were promoted in production, with the one before as rolled_back_to if their commit came earlier; and how many others there are by reason."""
    reason = F.when(F.col("state") != "PROMOTED", F.concat(F.lit("state "), F.lower("state"))).when(~F.col("target").eqNullSafe(F.lit("production")), F.concat(F.lit("target "), F.coalesce("target", F.lit("none"))))
    told = deployments.withColumn("reason", reason)
    kept = told.where("reason IS NULL").drop("reason")
    w = Window.partitionBy("project", "commit").orderBy("at", "deployment")
    return kept.withColumn("rolled_back_to", F.lag("deployment").over(w)), told.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def change_events(events: DataFrame, services: list[str], kinds: dict[str, str]) -> DataFrame:
    """event, service, kind, commit, version of the change events whose tags name one of the services; kind by the first word of the title that `kinds` lists, else other."""
    first = lambda name: F.regexp_extract(F.coalesce(F.get(F.filter("tags", lambda t: t.startswith(f"{name}:")), F.lit(0)), F.lit("")), "^[^:]*:(.*)$", 1)
    kind = F.lit("other")
    for word, name in reversed(kinds.items()):
        kind = F.when(F.lower("title").rlike(rf"\b{word}\b"), name).otherwise(kind)
    own = events.withColumn("service", first("service")).where(F.col("service").isin(*services))
    commit = first("git.commit.sha")
    return own.select("event", "service", kind.alias("kind"), F.when(commit.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), commit).alias("commit"), F.nullif(first("version"), F.lit("")).alias("version"))


def busiest(rows: DataFrame, group: str, name: str, hits: str, largest: bool) -> DataFrame:
    """group, name: the name with the most hits; of equals the largest or the smallest."""
    total = rows.groupBy(group, name).agg(F.sum(hits).alias("_h"))
    if largest:
        return total.groupBy(group).agg(F.max(F.struct("_h", name)).alias("m")).select(group, F.col(f"m.{name}"))
    return total.groupBy(group).agg(F.min(F.struct((-F.col("_h")).alias("key"), name)).alias("m")).select(group, F.col(f"m.{name}"))


def log_sources(lines: DataFrame, least: int = 10) -> DataFrame:
    """source, verdict: stamped if its lines carry service and version, unstamped if only service, anonymous without service, quiet below `least` lines."""
    own = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("service").isNotNull().cast("int")).alias("s"), F.avg(F.col("version").isNotNull().cast("int")).alias("v"))
    return own.select("source", F.when(F.col("n") < least, "quiet").when(F.col("s") < 0.5, "anonymous").when(F.col("v") < 0.5, "unstamped").otherwise("stamped").alias("verdict"))


def notices(reads: DataFrame, allowlist: DataFrame) -> DataFrame:
    """ref, vendor, state, start, end, superseded_by of vendors' notices, by their last read.

    reads: vendor, notice (may be null), product, text, state (announced, confirmed or cancelled), start, end, read_at,
    supersedes (a ref or null). Only vendors of the allowlist count. A notice without an identifier is named by a
    digest of vendor, product and start. One that another supersedes is superseded, unless it was cancelled.
    """
    derived = F.substring(F.sha2(F.concat_ws("|", "vendor", "product", F.coalesce(F.col("start").cast("string"), F.lit("unknown"))), 256), 1, 16)
    own = reads.join(allowlist.select("vendor").distinct(), "vendor", "left_semi").withColumn("ref", F.concat_ws("/", "vendor", F.coalesce("notice", derived)))
    last = own.groupBy("ref").agg(F.max_by(F.struct("vendor", "state", "start", "end"), F.struct("read_at", "state")).alias("n"), F.max("supersedes").alias("_of"))
    by = last.where("_of IS NOT NULL").groupBy(F.col("_of").alias("ref")).agg(F.min("ref").alias("superseded_by"))
    state = F.when(F.col("superseded_by").isNotNull() & (F.col("n.state") != "cancelled"), "superseded").otherwise(F.col("n.state"))
    return last.join(by, "ref", "left").select("ref", "n.vendor", state.alias("state"), "n.start", "n.end", "superseded_by")


def declared_incidents(channels: DataFrame, key: bytes) -> DataFrame:
    """channel, severity, date, slug, declared_by (a pseudonym) of the channels (channel, name, creator, bot) that declare an incident; bots' don't."""
    from palimpsest.functions.values import incident_channel, pseudonym

    own = channels.where(~F.coalesce("bot", F.lit(False))).withColumn("c", incident_channel(F.col("name"))).where("c.skipped IS NULL")
    return own.select("channel", "c.severity", "c.date", "c.slug", pseudonym(F.coalesce("creator", F.lit("")), key).alias("declared_by"))


def link_changes(pages: DataFrame, before: DataFrame) -> DataFrame:
    """document, entity, action (link, retract or keep) from a page's links now and before (document, entity); pages that weren't read now are left alone."""
    read = pages.select("document").distinct()
    now = pages.where("entity IS NOT NULL").select("document", "entity").distinct().withColumn("_n", F.lit(True))
    old = before.join(read, "document", "left_semi").select("document", "entity").distinct().withColumn("_o", F.lit(True))
    both = now.join(old, ["document", "entity"], "full_outer")
    return both.select("document", "entity", F.when(F.col("_o").isNull(), "link").when(F.col("_n").isNull(), "retract").otherwise("keep").alias("action"))


def page_sections(blocks: DataFrame, most: int = 1200) -> DataFrame:
    """document, label, part, text: blocks (document, seq, heading, text) under their last heading, joined by lines and split into parts."""
    from palimpsest.functions.values import text_parts

    w = Window.partitionBy("document").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = blocks.withColumn("_at", F.coalesce(F.last(F.when(F.col("heading"), F.col("seq")), ignorenulls=True).over(w), F.lit(-1)))
    joined = own.groupBy("document", "_at").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("label"), F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("seq", "text")))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["text"]), "\n")
    return joined.select("document", F.coalesce("label", F.lit("")).alias("label"), F.posexplode(text_parts(text, most)).alias("part", "text"))


def window_events(windows: DataFrame) -> DataFrame:
    """kind, key, detail, window: what a service's windows (service, version, callee, window) tell: a node and a claim when it is
    first seen, an edge when a callee is, a rollout when its version changes, and a checkpoint for every window."""
    first = windows.groupBy("service").agg(F.min("window").alias("window"))
    node = first.select(F.explode(F.array(F.lit("node"), F.lit("claim"))).alias("kind"), F.col("service").alias("key"), F.lit("").alias("detail"), "window")
    edges = windows.where("callee IS NOT NULL").groupBy("service", "callee").agg(F.min("window").alias("window")).select(F.lit("edge").alias("kind"), F.col("service").alias("key"), F.col("callee").alias("detail"), "window")
    versions = windows.where("version IS NOT NULL").groupBy("service", "window").agg(F.max("version").alias("version"))
    moved = versions.withColumn("_old", F.lag("version").over(Window.partitionBy("service").orderBy("window"))).where("_old IS NOT NULL AND _old <> version")
    rollout = moved.select(F.lit("rollout").alias("kind"), F.col("service").alias("key"), F.concat_ws(">", "_old", "version").alias("detail"), "window")
    points = windows.select(F.lit("checkpoint").alias("kind"), F.lit("").alias("key"), F.lit("").alias("detail"), "window").distinct()
    return node.unionByName(edges).unionByName(rollout).unionByName(points)


def alert_policies(policies: DataFrame) -> DataFrame:
    """policy, group_key, watches: a policy observes each of its resources (array of type, labels map); grouped by the labels it names, in order."""
    key = F.array_join(F.transform("group_by", lambda g: F.concat(g, F.lit("="), F.coalesce(F.try_element_at(F.col("r.labels"), g), F.lit("")))), ",")
    own = policies.select("policy", "group_by", F.explode("resources").alias("r")).select("policy", key.alias("group_key"), F.concat(F.col("r.type"), F.lit("/"), F.coalesce(F.try_element_at("r.labels", F.lit("name")), F.lit(""))).alias("w"))
    return own.groupBy("policy", "group_key").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("watches"))
