"""Every registered query against its SQL, at the smallest scale factor."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from verification.compare import compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("key", QUERIES)
def test_query_matches_sql(spark, key):
    ok, message = compare(spark, SF_DIR, key, QUERIES[key], ORACLES.get(key))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
