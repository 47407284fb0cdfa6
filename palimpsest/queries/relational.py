"""Relational primitives over the star tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import relational as op
from palimpsest.registry import query
from palimpsest.sources.model import table


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45)")
def anti_join(spark, sf_dir):
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return p.join(l, p["p_partkey"] == l["l_partkey"], "left_anti").select("p_partkey", "p_name")


@query(
    """WITH b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
    SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL OUTER JOIN a ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n"""
)
def full_outer_diff(spark, sf_dir):
    o, cut = table(spark, sf_dir, "orders"), F.lit("1998-01-01").cast("timestamp")

    def counts(rows):
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    return op.keyed_diff(counts(o.where(F.col("o_orderdate") < cut)), counts(o.where(F.col("o_orderdate") >= cut)), "o_custkey", ["n"]).select("o_custkey", "change")


@query("SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) x WHERE r <= 3")
def top_k_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return op.top_k(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    return op.after_cursor(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (300000.0, -1), 50).where("o_totalprice < 300000")


@query(
    """SELECT n.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2"""
)
def star_join(spark, sf_dir):
    t = {x: table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier", "nation")}
    named = F.broadcast(t["nation"])  # 25 rows
    c = t["customer"].join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"))
    s = t["supplier"].join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    lines = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))


_MONEY = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)"


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_MONEY} AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("total"))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_MONEY} AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    t, rf, ls = table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus")
    return t.groupingSets([[rf], [ls], []], rf, ls).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey").distinct())


@query("SELECT c_mktsegment AS k FROM customer UNION SELECT o_orderpriority FROM orders")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).distinct()


@query(
    """WITH l AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 1),
    j AS (SELECT coalesce(l.k, f.k) AS k, l.k IS NOT NULL AS a, f.k IS NOT NULL AS b FROM (SELECT DISTINCT k FROM l) l FULL OUTER JOIN (SELECT DISTINCT k FROM f) f ON l.k = f.k)
    SELECT CASE WHEN NOT a THEN 'extra' WHEN NOT b THEN 'missing' ELSE 'matched' END AS side, count(*) AS n FROM j GROUP BY 1"""
)
def set_reconciliation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return op.reconcile(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), "k").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT s_suppkey, o_orderkey FROM (SELECT l_suppkey AS s_suppkey, l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC) AS r FROM lineitem) x WHERE r = 1"""
)
def lateral_latest(spark, sf_dir):
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.struct("l_shipdate", "l_orderkey")).alias("m"))
    return best.select("s_suppkey", F.col("m.l_orderkey").alias("o_orderkey"))


@query(
    """SELECT o_custkey, o_orderkey, total, total > 5 AS truncated FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) x WHERE r <= 5"""
)
def capped_with_note(spark, sf_dir):
    return op.capped(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "total", "truncated")


@query(
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) x WHERE r = 1"""
)
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return op.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def shared_owner(spark, sf_dir):
    """Pairs of suppliers under one nation, smaller key first."""
    s = table(spark, sf_dir, "supplier")
    a, b = s.select("s_nationkey", F.col("s_suppkey").alias("left_key")), s.select("s_nationkey", F.col("s_suppkey").alias("right_key"))
    return a.join(b, "s_nationkey").where("left_key < right_key").select("left_key", "right_key")


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def filtered_aggregates(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(
    """SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running,
    dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders"""
)
def window_functions(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(12,2)")).over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("running"),
        F.dense_rank().over(by.orderBy("o_orderpriority")).alias("priority_rank"), F.ntile(4).over(by.orderBy("o_totalprice", "o_orderkey")).alias("quarter"),
    )


@query("SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x) y GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("SELECT epoch_us(w) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) x GROUP BY 1")
def sliding_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start"), "n")


@query("WITH e AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 3 + s_nationkey) % 60 AS dst FROM supplier) SELECT DISTINCT x.src AS node, x.dst AS via, y.dst AS far FROM e x JOIN e y ON y.src = x.dst WHERE y.dst <> x.src")
def two_hop_join(spark, sf_dir):
    i = F.col("s_suppkey")
    edges = table(spark, sf_dir, "supplier").select(i.alias("src"), ((i * 3 + F.col("s_nationkey")) % 60).alias("dst")).distinct()
    return op.two_hops(edges, edges.select(F.col("src").alias("node")).distinct())


@query("SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey % 97 = s_suppkey % 97 OR c_nationkey * 1000 + c_custkey % 10 = s_nationkey * 1000 + s_suppkey % 10")
def disjunctive_join(spark, sf_dir):
    """Pairs that agree on one of two keys."""
    c = table(spark, sf_dir, "customer").withColumn("a", F.col("c_custkey") % 97).withColumn("b", F.col("c_nationkey") * 1000 + F.col("c_custkey") % 10)
    s = table(spark, sf_dir, "supplier").withColumn("x", F.col("s_suppkey") % 97).withColumn("y", F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 10)
    return op.any_of(c, s, [("a", "x"), ("b", "y")], "c_custkey", "s_suppkey")


@query(
    """WITH p AS (SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0), r AS (SELECT event_id AS id, user_id, value FROM events WHERE event_id % 3 = 1), j AS (SELECT p.event_id, r.id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.value - r.value), r.value, r.id) AS n FROM p JOIN r ON r.user_id = p.user_id AND abs(p.value - r.value) <= 5)
    SELECT p.event_id, j.id AS near FROM p LEFT JOIN j ON j.event_id = p.event_id AND n = 1"""
)
def nearest_match(spark, sf_dir):
    """The row of the same key whose value is nearest, if one is near."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return op.nearest(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1"), "user_id", "value", "event_id", 5.0).select("event_id", "near")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def queue_pop(spark, sf_dir):
    """A queue without its first hundred rows."""
    return op.popped(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], 100)[1].select("o_orderkey")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) AS s, row_number() OVER w AS n, sum(length(o_orderpriority)) OVER (w ROWS UNBOUNDED PRECEDING) AS t, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    k AS (SELECT r.o_custkey, max(h) AS kept FROM r JOIN (SELECT DISTINCT o_custkey, greatest(1, c // (1 << i)) AS h FROM r, range(0, 17) g(i)) z ON z.o_custkey = r.o_custkey AND r.n = z.h WHERE t <= 60 GROUP BY 1) SELECT r.o_custkey, o_orderkey, coalesce(kept, 1) < c AS cut FROM r LEFT JOIN k ON k.o_custkey = r.o_custkey WHERE n <= coalesce(kept, 1)"""
)
def size_cap_by_halving(spark, sf_dir):
    """Rows of a digest, halved in number until it fits its size."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.length("o_orderpriority").alias("s"))
    return op.halved(o, "o_custkey", "o_orderkey", "s", 60).select("o_custkey", "o_orderkey", "cut")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract(props, '$.k') IS NOT NULL AS has, CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 AS is_seven FROM events")
def json_operators(spark, sf_dir):
    """A field of a document as text, whether it is there, and whether the document contains it with a value."""
    bag = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.map_contains_key(bag, F.lit("k")).alias("has"), (F.element_at(bag, F.lit("k")) == "7").alias("is_seven"))
