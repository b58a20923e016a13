"""Every registered query against its SQL twin."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from gridtide.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert difference(df, con, ORACLE[name]) is None


def test_the_entry_hands_out_all_of_them():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["event_id", "id", "ts_ms", "consumption", "expected"]
