"""Every core query against its SQL twin; those without one must give rows of a stable schema."""

import pytest
from compare import same
from conftest import SF

from recollect.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
