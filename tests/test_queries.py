import pytest

from conftest import same_rows
from plinth.plans import degrees, pages, records, tables, texts  # noqa: F401
from plinth.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_says_the_same(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
