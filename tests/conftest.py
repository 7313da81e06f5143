import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from rows import RAW_DDL, at  # noqa: E402

from stationflow.session import apply_settings  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("stationflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield apply_settings(session)
    session.stop()


@pytest.fixture(scope="session")
def make_raw(spark):
    """Status rows of one station from (minute offset, vehicles) pairs."""

    def build(points, station="A", start=at(2026, 1, 5, 12), system="s"):
        rows = [
            (system, station, start + dt.timedelta(minutes=m), v, 5, True, True, True)
            for m, v in points
        ]
        return spark.createDataFrame(rows, RAW_DDL)

    return build


@pytest.fixture(scope="session")
def make_stations(spark):
    def build(*rows):
        return spark.createDataFrame(
            [("s", *row) for row in rows],
            "system_id string, station_id string, capacity bigint",
        )

    return build
