import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("customer", "orders", "part")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("roomledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events_of(tmp_path_factory):
    """Runs code in a session of its own with an event log; returns its events."""

    def run(code):
        folder = tmp_path_factory.mktemp("events")
        script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[1])!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.dir", {str(folder)!r}).config("spark.eventLog.compress", "false")
    .config("spark.eventLog.rolling.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {str(folder) + "/shared"!r}).getOrCreate())
out = {str(folder) + "/out"!r}
{code}
spark.stop()
"""
        subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300)
        return [json.loads(line) for file in folder.iterdir() if file.is_file() for line in file.open()]

    return run


def sql_rows(sf_dir, statement):
    """Columns and rows of a SQL statement over the Parquet tables of a folder."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def comparable(columns, rows):
    """Rows with columns in name order, in a fixed row order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        return repr(round(value, 9)) if isinstance(value, float) else repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def assert_same_as_sql(df, sf_dir, statement):
    columns, rows = sql_rows(sf_dir, statement)
    assert sorted(df.columns) == sorted(columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, rows)
