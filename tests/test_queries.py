"""Every registered query of the reference's operators against SQL on another engine, and stable schemas."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

from corpusloom.plans import registered as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    assert spark_rows(core.QUERIES[name](spark, sf)) == duck_rows(duck.sql(core.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs_again_alike(spark, sf, name):
    first, again = (spark_rows(core.QUERIES[name](spark, sf)) for _ in range(2))
    assert first == again
    assert first[1]


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
