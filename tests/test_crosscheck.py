import pytest

import __spark_entry__ as entry
from tests.crosscheck import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], SF) is None


def test_every_query_is_checked():
    """Those without SQL are worked out row by row in test_brute."""
    assert {n for n in set(QUERIES) - set(SQL) if n.startswith("q_")} == {"q_raw_row_keys", "q_fuzzy_clusters", "q_greedy_compaction", "q_resolve_titles", "q_sessions"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
