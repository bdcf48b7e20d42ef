"""Every registered query against its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES = entry.queries()
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_as_twin(spark, con, sf_dir, name):
    difference, _ = compare(spark, con, QUERIES[name], TWINS[name], sf_dir)
    assert difference == ""


def test_queries_without_a_twin():
    """Only operators of the training-data part, which have brute-force tests of their own."""
    assert all(name == "pipeline" or name.startswith("op") for name in set(QUERIES) - set(TWINS))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
