"""Registration of queries and their SQL, and the views both sides read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow import schemas as S
from stationflow.operators.contract import conform
from stationflow.session import apply_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Instants as epoch microseconds, days and lists as text, doubles rounded."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ", ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    """Register a function of the loaded views under ``name``."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Views(apply_settings(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


class Views:
    """The given tables, and status and station tables derived from ``events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is looked up once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _events(self) -> DataFrame:
        station = F.col("user_id") % 20
        return self.table("events").select(
            "*",
            station.alias("station"),
            F.when(station < 10, "sys-a").otherwise("sys-b").alias("system_id"),
            station.cast("string").alias("station_id"),
            F.col("ts").cast("timestamp").alias("observed_at"),
        )

    @property
    def status(self) -> DataFrame:
        vehicles = F.floor("value").cast("bigint")
        seen = F.col("event_type") != "view"
        rows = self._events().select(
            "system_id",
            "station_id",
            "observed_at",
            vehicles.alias("num_vehicles_available"),
            F.when(seen, F.col("event_id") % 4).alias("num_vehicles_disabled"),
            F.greatest(F.lit(0), 50 - vehicles).alias("num_docks_available"),
            F.when(seen, F.col("event_id") % 3).alias("num_docks_disabled"),
            (F.col("event_type") != "error").alias("is_installed"),
            (F.col("event_type") != "signup").alias("is_renting"),
            F.lit(True).alias("is_returning"),
            F.when(seen, vehicles % 5).alias("num_vehicles_electric"),
            F.when(seen, vehicles - vehicles % 5).alias("num_vehicles_human"),
        )
        return conform(rows, S.STATION_STATUS)

    @property
    def history(self) -> DataFrame:
        rows = self._events().select(
            "system_id",
            "station_id",
            F.concat(F.lit("Station "), F.col("station_id")).alias("station_name"),
            F.when(F.col("event_type") != "view", F.concat(F.col("station_id"), F.lit(" Main St")))
            .alias("address"),
            (43.0 + F.col("station") / 100).alias("lat"),
            (-79.0 - F.col("station") / 100).alias("lon"),
            F.when(
                F.col("event_id") % 50 != 0, 10 * ((F.col("station") + F.day("ts")) % 4)
            ).alias("capacity"),
            (F.col("event_type") == "purchase").alias("is_charging_station"),
            "observed_at",
        )
        return conform(rows, S.STATIONS)


STATUS_SQL = """
status AS (
  SELECT CASE WHEN user_id % 20 < 10 THEN 'sys-a' ELSE 'sys-b' END AS system_id,
         CAST(user_id % 20 AS VARCHAR) AS station_id,
         ts AS observed_at,
         CAST(floor(value) AS BIGINT) AS num_vehicles_available,
         CASE WHEN event_type <> 'view' THEN event_id % 4 END AS num_vehicles_disabled,
         greatest(0, 50 - CAST(floor(value) AS BIGINT)) AS num_docks_available,
         CASE WHEN event_type <> 'view' THEN event_id % 3 END AS num_docks_disabled,
         event_type <> 'error' AS is_installed,
         event_type <> 'signup' AS is_renting,
         TRUE AS is_returning,
         CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) % 5 END
           AS num_vehicles_electric,
         CASE WHEN event_type <> 'view'
              THEN CAST(floor(value) AS BIGINT) - CAST(floor(value) AS BIGINT) % 5 END
           AS num_vehicles_human
  FROM events)"""

HISTORY_SQL = """
history AS (
  SELECT CASE WHEN user_id % 20 < 10 THEN 'sys-a' ELSE 'sys-b' END AS system_id,
         CAST(user_id % 20 AS VARCHAR) AS station_id,
         'Station ' || CAST(user_id % 20 AS VARCHAR) AS station_name,
         CASE WHEN event_type <> 'view' THEN CAST(user_id % 20 AS VARCHAR) || ' Main St' END
           AS address,
         43.0::DOUBLE + (user_id % 20)::DOUBLE / 100 AS lat,
         -79.0::DOUBLE - (user_id % 20)::DOUBLE / 100 AS lon,
         CASE WHEN event_id % 50 <> 0 THEN 10 * ((user_id % 20 + day(ts)) % 4) END AS capacity,
         event_type = 'purchase' AS is_charging_station,
         ts AS observed_at
  FROM events)"""

STATIONS_SQL = """
stations AS (
  SELECT system_id, station_id, arg_max_null(capacity, observed_at) AS capacity
  FROM history GROUP BY ALL)"""


# Codes of the catalog, one station left out.
CODES_SQL = """
codes AS (
  SELECT system_id, station_id,
         CAST(row_number() OVER (ORDER BY system_id, station_id) - 1 AS INTEGER)
           AS station_id_code
  FROM (SELECT DISTINCT system_id, station_id FROM history WHERE station_id <> '7'))"""


def with_views(*views: str) -> str:
    """A WITH clause over the named view texts."""
    return "WITH " + ",".join(v.strip() for v in views)
