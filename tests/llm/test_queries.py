"""Registered queries run; those with SQL agree with DuckDB."""

import pytest

from strataline.llm.registry import llm
from tests.oracle import assert_same, connect

QUERIES, SQL = llm()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    if name in SQL:
        assert_same(QUERIES[name], SQL[name], spark, sf_dir, con)
    else:
        df = QUERIES[name](spark, sf_dir)
        assert len(df.collect()) >= 0 and df.columns
