"""Every registered query of records against DuckDB."""

from __future__ import annotations

import pytest
from tests.conftest import same_rows

from tracemill.plans.oracles import ORACLES
from tracemill.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows_and_the_guard_holds(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
