"""Operators that SQL can't say, against plain Python and their own properties."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.operators import evaluation, graph, ledger, logmine, projection, resolution, telemetry
from palimpsest.operators.components import components
from palimpsest.operators.relational import after_cursor
from palimpsest.plans import algebra


def closed(events, source, t):
    """The latest assertion of a source at or before t, later arrivals first on a tie."""
    best = None
    for i, (s, state, at) in enumerate(events):
        if s == source and at <= t and (best is None or at >= best[0]):
            best = (at, state, i)
    return best and best[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("xyz"), st.integers(0, 9)), min_size=1, max_size=7))
def test_fold_is_the_closed_form_for_upserts(events):
    rows = pd.DataFrame([("e", "upsert", s, x, t) for s, x, t in events], columns=["entity", "kind", "source", "state", "t"])
    got = projection.fold(rows)
    for source in {s for s, *_ in events}:
        for t in range(11):
            own = got[(got["source"] == source) & (got["valid_from"] <= t) & (got["valid_to"].isna() | (got["valid_to"] > t))]
            assert len(own) <= 1
            assert (own["state"].iloc[0] if len(own) else None) == closed(events, source, t)


def test_fold_retraction_cuts_what_covers_it_when_it_arrives():
    def run(*events):
        return projection.fold(pd.DataFrame([("e", k, s, x, t) for k, s, x, t in events], columns=["entity", "kind", "source", "state", "t"]))

    got = run(("upsert", "A", "x", 2), ("retract", None, None, 5), ("upsert", "A", "y", 8))
    assert got[["valid_from", "valid_to"]].astype(object).where(got[["valid_from", "valid_to"]].notna(), None).values.tolist() == [[2, 5], [8, None]]
    late = run(("retract", None, None, 1), ("upsert", "A", "x", 0))
    assert late["valid_from"].tolist() == [0] and late["valid_to"].isna().all()


def test_onset():
    rng = random.Random(3)
    flat = [100 + rng.uniform(-4, 4) for _ in range(60)]
    at = [60 * i for i in range(60)]
    shifted = [v + (60 if i >= 40 else 0) for i, v in enumerate(flat)]
    found = telemetry.onset_of(at, shifted)
    assert found[0] == 60 * 40 and found[1] == "up" and found[4] == 1.0 and found[5] is None
    down = telemetry.onset_of(at, [-v for v in shifted])
    assert down[0] == 60 * 40 and down[1] == "down"
    assert telemetry.onset_of([], [])[5] == "absent"
    assert telemetry.onset_of(at[:7], flat[:7])[5] == "too_sparse"
    assert telemetry.onset_of(at, [5.0] * 60)[5] == "flat"
    spike = [v + (30 if i == 57 else 0) for i, v in enumerate(flat)]
    assert telemetry.onset_of(at, spike)[5] in ("no_crossing", "no_onset_detected")


def test_log_clusters():
    lines = pd.DataFrame([(f"worker job {x} done in time", 1, i) for i, x in enumerate("abc")] + [("disk full", 2, 9)], columns=["line", "n", "first"])
    got = logmine.fold(lines[lines["line"] != "disk full"])
    assert got.values.tolist() == [["worker job <*> done in time", 3, 0]]


def test_masks(spark):
    line = "GET http://a.b/c?d=1 from 10.0.0.1 at 2024-01-02T03:04:05Z took 15ms by bob@x.org id 123e4567-e89b-12d3-a456-426614174000 /var/log/x.log 42"
    row = spark.createDataFrame([(line,)], "l string").select(fn.masked(F.col("l")).alias("m"), fn.masked(fn.masked(F.col("l"))).alias("twice")).first()
    assert row["m"] == "GET <url> from <ip> at <ts> took <dur> by <email> id <uuid> <path> <num>"
    assert row["m"] == row["twice"]


def test_names(spark):
    cases = [("ns/checkout-svc-deploy", "checkout"), ("svc", "svc"), ("Check_Out.service", "checkout"), ("-svc", "svc"), ("", "")]
    df = spark.createDataFrame(cases, "raw string, want string").withColumn("got", fn.normalised_name(F.col("raw")))
    assert all(r["got"] == r["want"] for r in df.collect())
    pairs = [("candidate-api", "Candidate", 0.85), ("a b c", "a b d", 0.65), ("a b", "c d", 0.0), ("", "x", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double").withColumn("got", fn.name_score(F.col("a"), F.col("b")))
    assert all(r["got"] == pytest.approx(r["want"]) for r in df.collect())


def test_text_pieces(spark):
    row = spark.createDataFrame([("aaa bbb ccc dddddddddd e",)], "t string").select(fn.pieces(F.col("t"), 7).alias("p")).first()
    assert all(0 < len(p) <= 7 for p in row["p"]) and "".join(row["p"]).replace(" ", "") == "aaabbbcccdddddddddde"


def test_components(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "z"), ("e", "d")]
    got = {r["entity"]: r["component"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {**dict.fromkeys("abcde", "a"), **dict.fromkeys("xyz", "x")}


def test_redirect_chains(spark):
    chain = [(i, i - 1) for i in range(1, 20)]
    got = {r["id"]: r["canonical"] for r in resolution.canonical(spark.createDataFrame(chain, "id int, merged_into int")).collect()}
    assert got == {i: 0 for i in range(1, 20)}


def test_keyset_pages_meet_every_row_once(spark):
    rows = [(round(random.Random(i).random(), 1), i) for i in range(50)]
    df, cursor, seen = spark.createDataFrame(rows, "score double, id int"), None, []
    while page := after_cursor(df, "score", "id", cursor, 7).collect():
        seen += [(r["score"], r["id"]) for r in page]
        cursor = seen[-1]
    assert seen == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_posteriors_sum_to_one_million_units(spark):
    scores = [("i", f"h{n}", float(n)) for n in range(7)] + [("zero", "h", 0.0)]
    prior = ledger.priors(spark.createDataFrame(scores, "incident string, hypothesis string, score double"), "incident", "hypothesis", 0.25)
    judged = spark.createDataFrame([("i", "h1", "supports", "decisive"), ("i", "h6", "refutes", "strong")], "incident string, hypothesis string, direction string, strength string")
    got = ledger.posteriors(prior, judged, "incident", "hypothesis").collect()
    for incident in ("i", "zero"):
        assert sum(round(r["posterior"] * 1e6) for r in got if r["incident"] == incident) == 1_000_000
    by = {(r["incident"], r["hypothesis"]): r["posterior"] for r in got}
    assert by["zero", "open"] == 1 and by["i", "h0"] == 0 and max(by, key=lambda k: by[k] * (k[0] == "i")) == ("i", "h1")


def test_rank_prefers_the_recent_and_near(spark):
    rows = [("f", 1, "2024-01-01 00:00:00", 0, 5, True), ("f", 2, "2023-12-31 20:00:00", 0, 5, True), ("f", 3, "2024-01-01 00:00:00", 2, 1, True), ("f", 4, "2024-01-01 00:00:00", None, None, False)]
    df = spark.createDataFrame(rows, "focus string, change_id int, start string, hop int, weight int, attached boolean").withColumn("start", F.col("start").cast("timestamp"))
    got = {r["change_id"]: (r["rank"], r["score"]) for r in graph.rank(df, F.lit("2024-01-01 00:00:00").cast("timestamp"), 2).collect()}
    assert got[1] == (1, 1.0) and [got[i][0] for i in (3, 4, 2)] == [2, 3, 4]
    assert got[4][1] == round(0.5 + 0.35 / 4 + 0.15 / 6, 6)


def test_ordered_overlap(spark):
    cases = [(list("abcbdab"), list("bdcaba"), 4), ([], list("ab"), 0), (list("ab"), [], 0), (list("abc"), list("abc"), 3)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>, want int").withColumn("got", evaluation.common_subsequence(F.col("a"), F.col("b")))
    rows = df.withColumn("share", evaluation.ordered_overlap(F.col("a"), F.col("b"))).collect()
    assert all(r["got"] == r["want"] and r["share"] == (round(r["want"] / len(r["a"]), 6) if r["a"] else 0) for r in rows)


def test_credit(spark):
    rows = [(["a", "b", "c"], ["e1", "e2"], ["a", "x", "c"], ["e1", "e9"]), (["a"], [], [], []), (["a", "b"], ["e"], ["b", "a"], ["e"])]
    df = spark.createDataFrame(rows, "t array<string>, tv array<string>, g array<string>, gv array<string>")
    got = [tuple(r["c"]) for r in df.select(evaluation.credit(F.col("t"), F.col("tv"), F.col("g"), F.col("gv")).alias("c")).collect()]
    assert got == [(1.0, 1.0, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]


def test_power():
    assert 0.7 < evaluation.detectable(0.9, 40) < 0.8  # 40 trials tell 0.9 from 0.7, not from 0.8
    assert evaluation.required_trials(0.9, evaluation.detectable(0.9, 40)) == pytest.approx(40, abs=1e-3)
    assert evaluation.detectable(0.1, 40, "max") > 0.1 and evaluation.detectable(0.5, 2000) > evaluation.detectable(0.5, 200)
    assert all(x != x for x in (evaluation.detectable(0.9, 0), evaluation.detectable(1.2, 50), evaluation.detectable(0.01, 5)))


def test_terms():
    a = algebra.Term("subgraph", {"focus": " u8 ", "valid_at": "2024-01-01", "hops": 2, "edge_types": None})
    b = algebra.Term("subgraph", {"hops": 2, "valid_at": "2024-01-01", "focus": "u8"})
    assert algebra.key(a) == algebra.key(b)
    for bad in (algebra.Term("nothing"), algebra.Term("subgraph", {"focus": "u8"}), algebra.Term("subgraph", {"focus": "u", "valid_at": "t", "hops": 9}), algebra.Term("onset", {"focus": "u", "window": [2, 1]})):
        with pytest.raises(algebra.InvalidTerm):
            algebra.validate(algebra.normalise(bad))


@given(st.lists(st.tuples(st.booleans(), st.sampled_from("AB"), st.sampled_from("xyz"), st.integers(1, 40)), min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_fold_is_the_closed_form_in_order(events):
    """With events in valid-time order the fold's segments say, at every instant, what the closed form says."""
    import pandas as pd

    from palimpsest.operators import projection

    events = sorted(events, key=lambda e: e[3])
    rows = pd.DataFrame([("e", "retract" if cut else "upsert", None if cut else source, None if cut else state, t) for cut, source, state, t in events], columns=["entity", "kind", "source", "state", "t"])
    segments = projection.fold(rows)
    for at in range(0, 42):
        got = {(s, x) for _, s, x, f, t in segments.itertuples(index=False) if f <= at and (pd.isna(t) or at < t)}
        last = {}
        for i, (cut, source, state, t) in enumerate(events):
            if not cut and t <= at:
                last[source] = (t, i, state)
        # A retraction at t cuts what was asserted before it, in time and in arrival.
        want = {(s, x) for s, (t, i, x) in last.items() if not any(cut and t < end <= at for cut, _, _, end in events)}
        assert got == want


def test_gap_overlap_meets_no_gap_and_is_exact(spark):
    """Dense gaps of one source, open ends, null and unknown sources, touching ends; the plan joins buckets only."""
    import random
    from datetime import datetime, timedelta

    from palimpsest.operators.ledger import gap_overlap

    rng, base = random.Random(5), datetime(2024, 1, 1)

    def some(n, longest):
        for i in range(n):
            start = base + timedelta(minutes=30 * rng.randrange(200))
            yield i, rng.choice(["s0", "s1", "s2", None]), start, None if i % 17 == 0 else start + timedelta(minutes=30 * rng.randrange(1, longest))

    gaps = [(s, f, t) for i, s, f, t in some(60, 6) if s != "s2" and not (s == "s1" and t is None)]
    windows = [*some(400, 9), (400, "s0", datetime(2031, 1, 1), datetime(2031, 1, 2)), (401, "s1", datetime(2031, 1, 1), None)]
    later = lambda a, b: b is None or a < b
    want = {i: any(g == s and later(f, gt) and later(gf, t) for g, gf, gt in gaps if g is not None) for i, s, f, t in windows}
    got = gap_overlap(spark.createDataFrame(windows, "window long, source string, valid_from timestamp, valid_to timestamp"), spark.createDataFrame(gaps, "source string, gap_from timestamp, gap_to timestamp"))
    assert {r["window"]: r["in_gap"] for r in got.collect()} == want and len(set(want.values())) == 2
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def brute_pairs(rows, match):
    """rows: (entity, ...); the distinct pairs of different entities of which some rows match, in either order."""
    return {(min(x[0], y[0]), max(x[0], y[0])) for x in rows for y in rows if x[0] != y[0] and match(x, y)}


def shuffled_pairs(df):
    """Operators above the join of the two sides that would shuffle its pairs."""
    top = df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    return [x for x in ("Aggregate", "Window", "RepartitionByExpression") if x in top]


CLAIM = "claim_id string, entity string, type string, namespace string, value string, source string, attrs map<string,string>"


@pytest.mark.parametrize("block", [4096, 3])
def test_rules_shuffle_no_pairs(spark, monkeypatch, block):
    """Blocks don't change the pairs, entities with several rows give them once, and single ones without a shuffle of pairs."""
    from palimpsest.operators import rules as op

    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "MEETINGS", 50)
    rng = random.Random(7)
    hosts = lambda name: [(name(i), f"h{rng.randrange(4)}" if i % 9 else None, rng.random() < 0.4) for i in range(60)]
    for name, once in ((lambda i: f"c{i}", True), (lambda i: f"c{i * i % 23}", False)):
        rows = hosts(name)
        claims = spark.createDataFrame([(f"k{i}", e, "", op.ADDRESS, v, "s", {op.ALLOWLISTED: "v"} if x else None) for i, (e, v, x) in enumerate(rows)], CLAIM)
        pairs = op.allowlisted_host(claims)
        assert sorted(map(tuple, pairs.collect())) == sorted(brute_pairs(rows, lambda x, y: x[1] is not None and x[1] == y[1] and x[2] and not y[2]))
        assert not once or shuffled_pairs(pairs) == []
        spans = lambda i: {op.K8S_DEPLOYMENT: f"d{i % 3}", op.K8S_NAMESPACE: "n"}
        claims = spark.createDataFrame([(f"k{i}", name(i), "", op.OTEL if i % 2 else op.DEPLOYMENT, f"n/d{i % 3}", "s", spans(i) if i % 2 else None) for i in range(60)], CLAIM)
        pairs = op.spans_in_workload(claims)
        assert sorted(map(tuple, pairs.collect())) == sorted(brute_pairs([(name(i), i % 2, i % 3) for i in range(60)], lambda x, y: x[1] > y[1] and x[2] == y[2]))
        assert not once or shuffled_pairs(pairs) == []


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("modulus", [1000, 17])
def test_decided_shuffles_no_pairs(spark, monkeypatch, block, modulus):
    """Of rules the decision is that of their pairs; single entities need no shuffle of pairs, others (17 entities of 70 rows) get it right too."""
    from palimpsest.operators import rules as op

    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "MEETINGS", 50)
    entity = lambda i: f"c{i % modulus}"
    hosts = spark.createDataFrame([(f"h{i}", entity(i), "", op.ADDRESS, f"h{i % 5}", "s", {op.ALLOWLISTED: "v"} if i % 3 == 0 else None) for i in range(0, 70)], CLAIM)
    databases = spark.createDataFrame([(f"d{i}", entity(i), "", op.SQL_INSTANCE, "x", f"s{i % 3}", {op.CONNECTION: f"p:r:d{i % 4}"}) for i in range(10, 70)], CLAIM)
    named = spark.createDataFrame([(f"n{i}", entity(i), ("CONFIG", "OWNER", "")[i % 3], op.OTEL, f"svc{i % 3}", "s", None) for i in range(0, 60)], CLAIM)
    owners = spark.createDataFrame([(entity(i), i % 2) for i in range(70)], "entity string, owner int")
    got = op.decided({"P5": op.same_owner.rule(named, owners), "C7": op.same_connection.rule(databases), "C6": op.allowlisted_host.rule(hosts)})
    want = op.decided({"P5": op.same_owner(named, owners), "C7": op.same_connection(databases), "C6": op.allowlisted_host(hosts)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r["rule"] for r in want.collect()} >= {"C6", "C7"}
    assert modulus < 1000 or shuffled_pairs(got) == []


def test_notices_and_owners_shuffle_no_pairs(spark):
    """P5 and P6 meet their own rows: each two once, with their residual tests."""
    from palimpsest.operators import rules as op

    days = [(i % 6, i % 6 + 1 + i % 3) for i in range(60)]
    claims = spark.createDataFrame([(f"k{i}", f"c{i}", "", op.NOTICE, f"v/p{i % 2}@2024-01-{f + 1:02d}T00:00:00Z..2024-01-{t + 1:02d}T00:00:00Z", "s", None) for i, (f, t) in enumerate(days)], CLAIM)
    pairs = op.same_notice(claims)
    rows = [(f"c{i}", i % 2, *d) for i, d in enumerate(days)]
    assert sorted(map(tuple, pairs.collect())) == sorted(brute_pairs(rows, lambda x, y: x[1] == y[1] and x[2] < y[3] and y[2] < x[3]))
    assert shuffled_pairs(pairs) == []
    claims = spark.createDataFrame([(f"k{i}", f"c{i}", ("CONFIG", "OWNER", "SERVICE")[i % 3], op.OTEL, f"svc{i % 2}", "s", None) for i in range(60)], CLAIM)
    pairs = op.same_owner(claims, spark.createDataFrame([(f"c{i}", i % 4) for i in range(60)], "entity string, owner int"))
    rows = [(f"c{i}", i % 4, i % 3) for i in range(60)]
    assert sorted(map(tuple, pairs.collect())) == sorted(brute_pairs(rows, lambda x, y: x[1] == y[1] and (x[2] == y[2] or 2 in (x[2], y[2]))))
    assert shuffled_pairs(pairs) == []
