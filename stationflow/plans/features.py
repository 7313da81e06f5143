"""Features and labels of the availability forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stationflow import schemas as S
from stationflow.functions.clock import MINUTE_US, cycle_position, local_hour
from stationflow.functions.clock import local_weekday, micros
from stationflow.functions.measures import occupancy_ratio
from stationflow.operators.asof import asof_join, nearest_columns, within
from stationflow.operators.buckets import BUCKET, HOME, with_buckets
from stationflow.operators.contract import require_columns
from stationflow.operators.lookup import attach
from stationflow.operators.rolling import running_totals, trailing_mean, trailing_std
from stationflow.session import require_utc

STATUS_FLAGS = ("is_installed", "is_renting", "is_returning")


@dataclass(frozen=True)
class FeatureSpec:
    """Minutes and zone of the feature columns; defaults fit a 5-minute cycle.

    ``bucket_us`` is the width of a station's time buckets; it follows from the reach if left out.
    """

    lags: tuple[int, ...] = S.LAG_MINUTES
    lag_tolerance: int = S.LAG_TOLERANCE_MINUTES
    delta: int = 15
    means: tuple[int, ...] = (30, 60)
    stds: tuple[int, ...] = (30,)
    zone: str = S.LOCAL_ZONE
    bucket_us: int | None = None

    @property
    def reach_us(self) -> int:
        """How far back a feature can look."""
        furthest = max(max(self.lags) + self.lag_tolerance, *self.means, *self.stds)
        return furthest * MINUTE_US

    @property
    def rolling_columns(self) -> list[str]:
        widths = sorted({*self.means, *self.stds})
        return [
            name
            for m in widths
            for name, used in ((f"roll_mean_{m}m", self.means), (f"roll_std_{m}m", self.stds))
            if m in used
        ]

    @property
    def columns(self) -> list[str]:
        """Feature columns in their fixed order."""
        return [
            "station_id",
            "capacity",
            "num_vehicles_available",
            "num_docks_available",
            "occupancy_ratio",
            *[f"lag_{m}m_vehicles" for m in self.lags],
            f"delta_{self.delta}m",
            *self.rolling_columns,
            "hour_sin",
            "hour_cos",
            "dow_sin",
            "dow_cos",
        ]

    @property
    def output(self) -> list[str]:
        return ["system_id", "observed_at", *self.columns, *STATUS_FLAGS]


DEFAULT_SPEC = FeatureSpec()


def _measured(
    raw: DataFrame, spec: FeatureSpec, label: tuple[int, int] | None
) -> DataFrame:
    """All windowed columns (and the label, if asked for) behind one shuffle."""
    ahead_us = 0 if label is None else sum(label) * MINUTE_US
    us, vehicles = F.col("_us"), F.col("num_vehicles_available")
    rows = raw.select(*S.RAW_COLUMNS, micros("observed_at").alias("_us"))
    spread = with_buckets(
        rows, us, back_us=spec.reach_us, ahead_us=ahead_us, width_us=spec.bucket_us
    )
    part = [*S.STATION_KEY, BUCKET]
    rising = Window.partitionBy(*part).orderBy(us)

    windowed = running_totals(rising, vehicles, means=spec.means, stds=spec.stds)
    for m in spec.lags:
        windowed += nearest_columns(rising, us, vehicles, m * MINUTE_US, f"lag{m}")
    measured = spread.select("*", *windowed)

    derived = []
    for m in spec.lags:
        _, value = within(us, (m + spec.lag_tolerance) * MINUTE_US, f"lag{m}")
        derived.append(value.alias(f"lag_{m}m_vehicles"))
    derived += [trailing_mean(m).alias(f"roll_mean_{m}m") for m in spec.means]
    derived += [trailing_std(m).alias(f"roll_std_{m}m") for m in spec.stds]
    measured = measured.select(*S.RAW_COLUMNS, "_us", BUCKET, HOME, *derived)

    if label is not None:
        horizon, tolerance = label
        falling = Window.partitionBy(*part).orderBy(-us)
        ahead = nearest_columns(falling, us, vehicles, horizon * MINUTE_US, "target")
        target_us, target = within(us, ahead_us, "target")
        measured = measured.select("*", *ahead).select(
            "*",
            F.timestamp_micros(target_us).alias("target_observed_at"),
            target.alias("target_num_vehicles_available"),
        ).where(F.col("target_num_vehicles_available").isNotNull())
    return measured.where(F.col(HOME))


def _finish(
    measured: DataFrame, stations: DataFrame, spec: FeatureSpec, extra: tuple[str, ...]
) -> DataFrame:
    """Row-wise columns: capacity, occupancy, delta and local calendar."""
    on = [k for k in S.STATION_KEY if k in stations.columns]
    joined = attach(measured, stations.select(*on, "capacity"), on)
    hour_sin, hour_cos = cycle_position(local_hour("observed_at", spec.zone), 24)
    dow_sin, dow_cos = cycle_position(local_weekday("observed_at", spec.zone), 7)
    vehicles = F.col("num_vehicles_available")
    computed = {
        "occupancy_ratio": occupancy_ratio(vehicles, "capacity"),
        f"delta_{spec.delta}m": vehicles - F.col(f"lag_{spec.delta}m_vehicles"),
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
    }
    return joined.select(
        *[computed[c].alias(c) if c in computed else c for c in (*spec.output, *extra)]
    )


def _check_inputs(raw: DataFrame, stations: DataFrame) -> None:
    require_columns(raw, S.RAW_COLUMNS, label="raw")
    require_columns(stations, ("station_id", "capacity"), label="stations")
    if isinstance(raw.schema["observed_at"].dataType, T.TimestampNTZType):
        require_utc(raw.sparkSession)


def compute_features(
    raw: DataFrame, stations: DataFrame, spec: FeatureSpec = DEFAULT_SPEC
) -> DataFrame:
    """Features of every status row; each looks only at that row and earlier ones.

    ``raw`` must be unique in (system, station, observed_at). ``stations`` holds one
    capacity per station.
    """
    _check_inputs(raw, stations)
    return _finish(_measured(raw, spec, None), stations, spec, ())


def add_target(
    features: DataFrame,
    raw: DataFrame,
    *,
    horizon_minutes: int = S.HORIZON_MINUTES,
    tolerance_minutes: int = S.LABEL_TOLERANCE_MINUTES,
) -> DataFrame:
    """Label feature rows with the first reading at or after the horizon; drop the rest."""
    labeled = asof_join(
        features,
        raw,
        by=S.STATION_KEY,
        left_time="observed_at",
        right_time="observed_at",
        values={"num_vehicles_available": "target_num_vehicles_available"},
        strategy="forward",
        offset_minutes=horizon_minutes,
        tolerance_minutes=tolerance_minutes,
        matched_time="target_observed_at",
    )
    return labeled.dropna(subset=["target_num_vehicles_available"])


def labeled_features(
    raw: DataFrame,
    stations: DataFrame,
    spec: FeatureSpec = DEFAULT_SPEC,
    *,
    horizon_minutes: int = S.HORIZON_MINUTES,
    tolerance_minutes: int = S.LABEL_TOLERANCE_MINUTES,
) -> DataFrame:
    """``add_target(compute_features(...))`` with features and label behind one shuffle."""
    _check_inputs(raw, stations)
    measured = _measured(raw, spec, (horizon_minutes, tolerance_minutes))
    return _finish(
        measured,
        stations,
        spec,
        ("target_observed_at", "target_num_vehicles_available"),
    )
