"""Every registered query with SQL equals DuckDB; every query runs and keeps its columns on empty tables."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from conftest import SF, SF_SMALL
from oracles import assert_same

from corpusloom.plans import registry


#: Queries with a row per table, however few rows it has.
COUNTS = {"base_removal", "document_removal"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert_same(df, duck(SF), registry.ORACLES[name])
    else:
        assert df.columns and df.count() > 0


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for p in Path(SF_SMALL).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).coalesce(1).write.parquet(str(folder / p.name))
    yield str(folder)
    shutil.rmtree(folder, ignore_errors=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    df = registry.QUERIES[name](spark, empty_dir)
    if name in COUNTS:
        assert {r["rows"] for r in df.collect()} == {0}
    else:
        assert df.count() <= 1  # a total over nothing may be one row
    assert df.columns


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
