"""Every catalogued query: against its SQL where it has one, else that it gives rows of a stable schema."""

from __future__ import annotations

import pytest
from oracle import assert_same

from tallyforge.catalog import ORACLE_SQL, QUERIES

#: The oldest forecasters have three years or more at every scale, so the smallest tables do.


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_fitted_query_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() >= 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["series_key", "method", "validation_smape", "predicted", "actual", "smape"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
