"""Every registered query vs its DuckDB oracle on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from duck_oracle import compare, duck

Q, O = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(O))
def test_query_matches_oracle(spark, sf_dir, con, name):
    assert compare(Q[name](spark, sf_dir), con, O[name]) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert Q[name](spark, sf_dir).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "margin_pct" in df.columns
