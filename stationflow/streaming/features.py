"""Features of the rows a batch brought, from the rolling window it updated.

Time-range frames are not available on a stream itself; the window already holds every row
a feature of a new row can look at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from stationflow import schemas as S
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec, compute_features


def batch_features(
    window: DataFrame, stations: DataFrame, new_rows: DataFrame, spec: FeatureSpec = DEFAULT_SPEC
) -> DataFrame:
    """One feature row per new row still inside the window."""
    capacity = stations.select(*S.STATION_KEY, "capacity")
    features = compute_features(window.select(*S.RAW_COLUMNS), capacity, spec)
    return features.join(new_rows.select(*S.IDENTITY), list(S.IDENTITY), "left_semi")
