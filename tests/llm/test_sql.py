"""Queries of the dealt operators beside their SQL."""

import pytest
from compare import compare, connect

from tablescope.llm.queries import registered

SF_DIR = "/root/testdata/sf0.001"
WITH_SQL = {name: q for name, q in registered().items() if q[1] is not None}


@pytest.mark.parametrize("name", list(WITH_SQL))
def test_query(spark, name):
    run, sql = WITH_SQL[name]
    assert compare(spark, connect(SF_DIR), SF_DIR, run, sql) == ""


def test_all_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(range(1, 14)) == {int(q[2:].split("_")[0]) for q in names if q.startswith("op") and q[2:3].isdigit()}
    assert "pipeline" in names
