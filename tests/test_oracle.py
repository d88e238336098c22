"""Every registered query against its DuckDB oracle (row count, columns, order-free values).

Runs at sf0.001 by default (set CODELENS_CHECK_SF to another folder for a bigger check).
Queries without oracle SQL are checked to run and to match their batch twin elsewhere.
"""

import os

import pytest

from codelens.plans.check import compare, duck_connection
from codelens.plans.registry import load_all

SF = os.environ.get("CODELENS_CHECK_SF", "/root/testdata/sf0.001")
REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, con, name):
    fn, sql = REG[name]
    if sql is None:
        assert fn(spark, SF).count() >= 0
        return
    r = compare(spark, name, fn, sql, SF, con)
    assert r.ok, r.detail


def test_registry_contract():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(REG) <= set(q) and set(o) <= set(q)
    q, o = {n: q[n] for n in REG}, {n: o[n] for n in o if n in REG}  # others have tests of their own
    assert set(q) == set(o)
    assert all(isinstance(s, str) and s.strip() for s in o.values())
    assert all(name == name.lower() and not name.startswith("op") for name in q)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
