"""One small Spark session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers

SF_SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    scratch = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(scratch / "checkpoint"),
        "spark.sql.warehouse.dir": str(scratch / "warehouse"),
        "spark.local.dir": str(scratch / "local"),
        "spark.driver.memory": "3g",
    }
    session = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '2')}]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the tables of a folder: duck(folder).execute(sql)."""
    import duckdb

    def connect(folder: str):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        return con

    return connect
