"""Queries against plain Python over all rows of the tables: none reads a part of them alone."""

import os
import re
from collections import defaultdict

import pyarrow.parquet as pq

from palimpsest import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, _ = registry.load()


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def k(event):
    return int(re.search("[0-9]+", event["props"])[0])


def test_project_fold_has_every_entity(spark):
    lanes = defaultdict(list)
    for e in rows("events"):
        lanes[f"u{e['user_id']}", f"s{k(e) % 3}"].append((e["ts"], e["event_id"], e["event_type"]))
    want = set()
    for (entity, source), lane in lanes.items():
        lane.sort()
        want |= {(entity, source, a[2], a[0], b[0] if b else None) for a, b in zip(lane, [*lane[1:], None], strict=True)}
    got = QUERIES["project_fold"](spark, SF).selectExpr("entity", "source", "state", "timestamp_micros(valid_from) AS f", "timestamp_micros(valid_to) AS t").collect()
    plain = lambda x: x and x.replace(tzinfo=None)
    assert {(r[0], r[1], r[2], plain(r[3]), plain(r[4])) for r in got} == {(*x[:3], plain(x[3]), plain(x[4])) for x in want}
    assert len(got) == len(want)


def test_new_patterns_are_of_the_whole_line(spark, tmp_path):
    """What is new stands after the first 60 characters."""
    long = "https://example.org/" + "a" * 60
    pages = [(i, f"{long} {'retried' if i in (2, 4, 8) else 'once'}") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in QUERIES["new_patterns"](spark, str(tmp_path)).collect()}
    line = lambda word, end="": f"GET <url> {word} took <dur> from <ip> at <ts> status <num>{end}"
    ends = (" upstream gone", " pool exhausted after <num> tries")  # of pages 4 and 14, 8 and 18
    assert got == {(line("retried"), 1)} | {(line(word, end), 1) for word in ("retried", "once") for end in ends}


def test_facet_precedence_is_over_all_assertions(spark, tmp_path):
    """On an entity whose facets occur in late assertions alone too."""
    names = ["cluster", "database", "workload", "service"]
    events = [(e["event_id"], e["user_id"], e["event_type"], e["value"], e["ts"], e["props"]) for e in rows("events")]
    events += [(-i, 1_000_000, events[0][2], 1.0, events[0][4], re.sub("[0-9]+", str(60 + i), events[0][5], count=1)) for i in range(2)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts timestamp, props string").write.parquet(str(tmp_path / "events.parquet"))
    want = defaultdict(set)
    for _, user, *_, props in events:
        want[f"u{user}"].add(names[(user + k({"props": props}) % 3) % 4])
    got = {r["entity"]: (r["facets"], r["type"]) for r in QUERIES["facet_precedence"](spark, str(tmp_path)).collect()}
    assert got == {e: (",".join(sorted(f)), max(f, key=names.index)) for e, f in want.items()}
    assert got["u1000000"] == ("cluster,database", "database")


def test_redirects_raw_expands_every_canonical_id(spark, tmp_path):
    spark.range(400).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    merged = {i: i - 1 - i % 3 for i in range(5, 400) if i % 5}
    want = [(i, i) for i in range(0, 400, 5)]
    for i in merged:
        end = i
        while end in merged:
            end = merged[end]
        want.append((end, i))
    got = [(r["canonical"], r["id"]) for r in QUERIES["redirects_raw"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {i for _, i in got} >= set(merged)


def test_cosine_topk_asks_with_every_twentieth_vector(spark, monkeypatch):
    """In one shard and block, and in many."""
    import numpy as np

    from palimpsest.operators import knowledge

    own = sorted((r["vec_id"], r["embedding"]) for r in rows("embeddings"))
    ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for at in np.flatnonzero(ids % 20 == 0):
        score = np.round(x @ x[at], 6)
        near = [j for j in np.lexsort((ids, -score)) if j != at][:10]
        want |= {(int(ids[at]), n + 1): (int(ids[j]), float(score[j])) for n, j in enumerate(near)}
    assert len(want) == 10 * sum(i % 20 == 0 for i, _ in own) > 100
    for shard, block in ((knowledge.SHARD, knowledge.BLOCK), (90, 7)):
        monkeypatch.setattr(knowledge, "SHARD", shard)
        monkeypatch.setattr(knowledge, "BLOCK", block)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in QUERIES["cosine_topk"](spark, SF).collect()}
        assert got == want
