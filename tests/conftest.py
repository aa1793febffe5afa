"""One local session for all tests; it starts here, as column expressions need one when modules are read."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SESSION = (
    SparkSession.builder.master("local[4]").appName("brickyard-tests").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION
