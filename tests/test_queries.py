"""Every query against its SQL form, on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_points
import check_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_queries.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, con, sf_dir, name):
    verdict, _, _ = check_queries.compare(spark, con, sf_dir, name)
    assert verdict == ("ok" if name in entry_points.oracle_sql() else "rows only")


def test_entry(spark):
    df = entry_points.entry(spark)
    assert len(df.columns) == 39 and not df.isEmpty()


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
