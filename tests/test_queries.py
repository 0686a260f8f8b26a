"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest
from compare import compare, connect

from tablescope.checks import registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registered()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    assert compare(spark, con, SF_DIR, run, sql) == ""


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_correlation_aggregate_is_not_used():
    """The built-in correlation raises on constant columns."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tablescope")
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "F.corr(" not in f.read(), name
