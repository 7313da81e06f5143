"""Newest row per key, and keep-last de-duplication.

Both are aggregations rather than ranked windows: each task reduces its own rows before
the shuffle, so a key with very many copies costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.schemas import IDENTITY, STATION_KEY


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """One whole row per key: the greatest by ``order_by`` (nulls smallest)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def newest_rows(df: DataFrame) -> DataFrame:
    """Current state of every station in a history."""
    return newest_per_key(df, STATION_KEY, ["observed_at"])


def current_capacity(history: DataFrame) -> DataFrame:
    """Newest capacity per station; a null newest capacity stays null."""
    return history.groupBy(*STATION_KEY).agg(
        F.max_by("capacity", "observed_at").alias("capacity")
    )


def last_time(df: DataFrame, name: str = "observed_at") -> DataFrame:
    """Newest time per station."""
    return df.groupBy(*STATION_KEY).agg(F.max("observed_at").alias(name))


def keep_last(
    df: DataFrame, sequence: Sequence[str], keys: Sequence[str] = IDENTITY
) -> DataFrame:
    """Drop replays of an identity; the row with the greatest ``sequence`` wins."""
    return newest_per_key(df, keys, sequence)
