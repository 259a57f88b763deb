"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, norm

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(DIR)


def core():
    from sectloom.plans.catalog import CORE

    return CORE


@pytest.mark.parametrize("name", sorted(core().sql))
def test_query_equals_sql(spark, db, name):
    got = core().queries[name](spark, DIR).toPandas()
    want = db.execute(core().sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
