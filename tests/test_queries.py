"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest

from voltaic.plans import queries

#: These find nothing to report in the smallest tables.
MAY_BE_EMPTY = {"hfo_detect", "event_detections"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    assert set(e.oracle_sql()) <= set(e.queries())
