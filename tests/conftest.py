from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from roadrisk.plans.relations import Inputs

    return Inputs(spark, SMALL)


def plain_rows(pdf) -> list[tuple]:
    """Rows of a pandas frame as Python values."""
    return [
        tuple(v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in row)
        for row in pdf.astype(object).itertuples(index=False)
    ]
