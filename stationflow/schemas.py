"""Declared table schemas, key columns and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

STATION_STATUS = "station_status"
STATIONS = "stations"
ARCHIVED_TABLES = (STATION_STATUS, STATIONS)

STATION_KEY = ("system_id", "station_id")
IDENTITY = ("system_id", "station_id", "observed_at")

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns.items()])


STATUS_SCHEMA = _table(
    system_id="string",
    station_id="string",
    observed_at="timestamp",
    num_vehicles_available="bigint",
    num_vehicles_disabled="bigint",
    num_docks_available="bigint",
    num_docks_disabled="bigint",
    is_installed="boolean",
    is_renting="boolean",
    is_returning="boolean",
    num_vehicles_electric="bigint",
    num_vehicles_human="bigint",
)
STATIONS_SCHEMA = _table(
    system_id="string",
    station_id="string",
    station_name="string",
    address="string",
    lat="double",
    lon="double",
    capacity="bigint",
    is_charging_station="boolean",
    observed_at="timestamp",
)
VEHICLE_TYPES_SCHEMA = _table(
    system_id="string",
    vehicle_type_id="string",
    form_factor="string",
    propulsion_type="string",
    name="string",
)
RUN_LOG_SCHEMA = _table(
    run_id="bigint",
    cycle_id="string",
    system_id="string",
    started_at="timestamp",
    finished_at="timestamp",
    status="string",
    row_count="bigint",
    error_message="string",
)
TABLE_SCHEMAS = {STATION_STATUS: STATUS_SCHEMA, STATIONS: STATIONS_SCHEMA}

# Columns the feature step needs from a status table.
RAW_COLUMNS = (
    "system_id",
    "station_id",
    "observed_at",
    "num_vehicles_available",
    "num_docks_available",
    "is_installed",
    "is_renting",
    "is_returning",
)

# --- fixed values -------------------------------------------------------
TRACKED_STATION_FIELDS = (
    "station_name",
    "address",
    "lat",
    "lon",
    "capacity",
    "is_charging_station",
)
ELECTRIC_PROPULSION = ("electric", "electric_assist")
LAG_MINUTES = (5, 15, 30, 60)
LAG_TOLERANCE_MINUTES = 5
LOCAL_ZONE = "America/Toronto"
HORIZON_MINUTES = 120
LABEL_TOLERANCE_MINUTES = 10
MIN_STATION_ROWS = 288
TRAIN_FRACTION = 0.7
VALIDATION_FRACTION = 0.15
LOOKBACK_MINUTES = 90
WINDOW_MINUTES = 120
MAX_DATA_AGE_MINUTES = 90
CYCLE_SECONDS = 300
PARQUET_CODEC = "zstd"
PARQUET_CODEC_LEVEL = 9
FEED_VERSION = "3.0"
FEED_NAMES = (
    "gbfs",
    "gbfs_versions",
    "geofencing_zones",
    "station_information",
    "station_status",
    "system_alerts",
    "system_information",
    "system_pricing_plans",
    "system_regions",
    "vehicle_status",
    "vehicle_types",
)
RENTAL_METHODS = (
    "accountnumber",
    "androidpay",
    "applepay",
    "creditcard",
    "key",
    "paypass",
    "phone",
    "transitcard",
)
PARKING_TYPES = (
    "other",
    "parking_lot",
    "sidewalk_parking",
    "street_parking",
    "underground_parking",
)
FORM_FACTORS = (
    "bicycle",
    "cargo_bicycle",
    "car",
    "moped",
    "scooter_standing",
    "scooter_seated",
    "other",
)
PROPULSION_TYPES = (
    "human",
    "electric_assist",
    "electric",
    "combustion",
    "combustion_diesel",
    "hybrid",
    "plug_in_hybrid",
    "hydrogen_fuel_cell",
)
