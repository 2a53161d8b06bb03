"""Every query against its SQL twin on the smallest tables."""

import pytest

from tests.compare import connect, rows
from tidemark.plans import balance_queries, binary_queries, build_queries, chunk_queries, composite_queries, join_queries, metric_queries, more_queries, sequence_queries, source_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
