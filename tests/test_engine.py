"""Every term of the algebra through the engine: answers, empty ones, late windows and invalid ones."""

import pytest

from palimpsest.plans import algebra
from palimpsest.plans.engine import Engine, instant

SF = "/root/testdata/sf0.001"
DAY = ["2024-01-10 00:00:00", "2024-01-14 00:00:00"]
AT = "2024-01-10T00:00:00Z"
TERMS = {
    "subgraph": {"focus": "u8", "valid_at": AT}, "diff": {"focus": "u8", "from": "2024-01-10T00:00:00", "to": "2024-01-12 00:00:00", "margin": 1}, "impact": {"focus": "u8", "valid_at": AT, "hops": 2},
    "pointers": {"focus": "u8", "valid_at": AT}, "node_history": {"focus": "u8"}, "resolution_audit": {"focus": "u8"}, "extent": {},
    "compare": {"focus": "u8", "baseline": ["2024-01-02", "2024-01-09"], "symptom": DAY}, "onset": {"focus": "u8", "window": ["2024-01-02", "2024-01-29"]}, "new_log_patterns": {"focus": "u8", "baseline": ["2024-01-02", "2024-01-03"], "symptom": ["2024-01-03", "2024-01-20"]},
    "error_spans": {"focus": "u8", "window": ["2024-01-02", "2024-01-29"]}, "errors_by_version": {"focus": "u8", "window": ["2024-01-02", "2024-01-29"]}, "monitor_state": {"focus": "u8", "window": ["2024-01-02", "2024-01-29"]},
    "knowledge_search": {"text": "the shop and the", "k": 3}, "chat_mentions": {"window": [0, 40]}, "chat_timeline": {"window": [0, 12]},
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF)


def test_all_terms_are_tried():
    assert set(TERMS) | {"exemplars", "drill_down"} == set(algebra.TERMS)


@pytest.mark.parametrize("name", sorted(TERMS))
def test_term(engine, name):
    answer = engine.execute(algebra.Term(name, TERMS[name]))
    assert answer.outcome in ("OK", "NO_DATA"), answer.reason
    if name not in ("chat_mentions", "diff", "new_log_patterns"):
        assert answer.outcome == "OK" and answer.rows.count() > 0


def test_handles(engine):
    answer = engine.execute(algebra.Term("errors_by_version", TERMS["errors_by_version"]))
    row = answer.rows.first()
    for name in ("exemplars", "drill_down"):
        found = engine.execute(algebra.Term(name, {"handle": algebra.handle(algebra.Term("errors_by_version", TERMS["errors_by_version"]), row["source"])}))
        assert found.outcome == "OK"
        assert {r["source"] for r in found.rows.collect()} == {row["source"]}
        with pytest.raises(algebra.InvalidTerm):
            engine.execute(algebra.Term(name, {"handle": "unknown:x"}))


@pytest.mark.parametrize("window, outcome", [
    (["2030-01-01T00:00:00", "2030-01-02T00:00:00"], "NOT_YET_INGESTED"), (["2001-01-01", "2001-01-02"], "OUTSIDE_RETENTION"), (["2024-01-20T00:00:00Z", "2025-01-01 00:00:00"], "PARTIAL"), (["2024-01-05 00:00:00", "2024-01-05 00:00:01"], "NO_DATA"),
])
def test_outcomes(engine, window, outcome):
    answer = engine.execute(algebra.Term("errors_by_version", {"focus": "u8", "window": window}))
    assert answer.outcome == outcome
    assert (answer.rows is None) == (outcome in ("NOT_YET_INGESTED", "OUTSIDE_RETENTION"))
    if outcome == "PARTIAL":
        assert answer.coverage[0] == instant(window[0]) and answer.coverage[1] < instant(window[1]) and answer.reason


def test_failed_and_invalid(engine):
    assert engine.execute(algebra.Term("subgraph", {"focus": "u8", "valid_at": AT, "edge_types": 5})).outcome == "QUERY_FAILED"
    for bad in ({"focus": "u8", "window": ["2024-01-02", "2024-01-01"]}, {"focus": "u8", "window": ["x", "y"]}, {"focus": "u8", "window": "2024"}, {"window": DAY}):
        with pytest.raises(algebra.InvalidTerm):
            engine.execute(algebra.Term("onset", bad))
    for name, more in (("diff", {"margin": 5}), ("diff", {"from": "2024-01-13"}), ("impact", {"hops": 9}), ("knowledge_search", {"k": 0})):
        with pytest.raises(algebra.InvalidTerm):
            engine.execute(algebra.Term(name, TERMS[name] | more))


def test_diff_parts(engine):
    parts = engine.diff("u8", "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    assert set(parts) == {"nodes", "edges", "changes", "targets"} and all(p.count() >= 0 for p in parts.values())


def test_other_reads(engine):
    at = "2024-01-10 00:00:00"
    assert engine.truncation("u8", at, 1).count() in (0, 1) and engine.shortest_route("u8", at, 2).count() > 0
    page = engine.suggestions(size=5).collect()
    assert page == sorted(page, key=lambda r: (-r["score"], r["pair"])) and len(page) <= 5
    rest = engine.suggestions(after=(page[-1]["score"], page[-1]["pair"]), size=5).collect()
    assert not {r["pair"] for r in rest} & {r["pair"] for r in page}
    assert all("u8" in (r["a"], r["b"]) for r in engine.suggestions("u8").collect())
    assert engine.invariants().columns
