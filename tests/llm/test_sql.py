"""Queries with SQL agree with it; all of them run over the smallest tables and over empty ones."""

import compare
import pytest

from photocat.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, con, name):
    rows, problem = compare.compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLE[name])
    assert problem is None and rows > 0


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []
