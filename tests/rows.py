"""Instants and columns of hand-written status rows."""

import datetime as dt

UTC = dt.timezone.utc


def at(*parts):
    return dt.datetime(*parts, tzinfo=UTC)


RAW_DDL = (
    "system_id string, station_id string, observed_at timestamp, "
    "num_vehicles_available bigint, num_docks_available bigint, "
    "is_installed boolean, is_renting boolean, is_returning boolean"
)
