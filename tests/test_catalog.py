"""Every query of the engine's own operators against its SQL."""

import os

import oracle
import pytest

from corvane import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("key", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, con, key):
    assert oracle.differences(catalog.QUERIES[key](spark, SF), catalog.ORACLE_SQL[key], con) == []


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, key):
    rows = catalog.QUERIES[key](spark, SF).collect()
    assert rows or key in ("stream_sessions", "significance")


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
