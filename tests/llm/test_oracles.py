"""Corpus queries against their SQL."""

import os

import pytest

from palimpsest.llm import queries

from ..oracle import connect, differs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert differs(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""
