"""Every query with oracle SQL against DuckDB, on the smallest scale."""

import pytest

import __spark_entry__ as entry
from beckon.plans import catalog
from tools.oracle_check import duck, rows

# The corpus operators have tests of their own in tests/llm.
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[name])
    assert got == rows([d[0] for d in res.description], res.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
