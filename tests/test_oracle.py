"""Every registered query agrees with its SQL on the smallest tables."""

import os

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from photocat.plans import registry  # noqa: E402

SF = os.environ.get("PHOTOCAT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    rows, problem = compare.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_the_flagship_query_runs(spark):
    assert entry.entry(spark).columns[0] == "photo_id"
