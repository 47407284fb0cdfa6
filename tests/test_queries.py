"""Every registered query against its oracle at the smallest scale."""

import os

import pytest

from palimpsest import registry

from .oracle import connect, differs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert differs(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry_point():
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_nothing_else_needs_the_corpus_operators():
    """Only the entry point names them, behind its guard."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in (root / "palimpsest").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "palimpsest.llm" not in path.read_text()
