"""Every registered query at the smallest scale: equal to its SQL oracle, or at least non-empty."""

import os

import pytest

from demandspark.plans.registry import load_all
from tests.oracle import connect, differences, rows_of

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = rows_of(QUERIES[name].run(spark, SF_DIR))
    if QUERIES[name].sql is None:
        assert len(got) > 0
        return
    assert differences(got, duck.execute(QUERIES[name].sql).df()) == []


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
