import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("cardiolake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series_of(spark):
    """DataFrame of records from {record: {column: list}}."""

    def build(records: dict):
        columns = list(next(iter(records.values())))
        rows = [
            (name, i, *[None if lists[c][i] is None else float(lists[c][i]) for c in columns])
            for name, lists in records.items()
            for i in range(len(lists[columns[0]]))
        ]
        schema = "record_id string, i long, " + ", ".join(f"{c} double" for c in columns)
        return spark.createDataFrame(rows, schema)

    return build
