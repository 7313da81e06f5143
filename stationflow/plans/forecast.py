"""Batch forecasts: one row per requested station, served or with the reason why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.clock import minutes
from stationflow.functions.measures import clip_to_capacity, whole_vehicles
from stationflow.operators.newest import newest_per_key, newest_rows
from stationflow.operators.recent import lookback
from stationflow.plans.dataset import CURRENT, encode_stations
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec, compute_features
from stationflow.plans.train import PREDICTED_DELTA, Model, model_rows, predict

# Reasons in the order they are checked, with the code a service would answer.
OUTCOMES = {
    "no_model": 503,
    "unknown_station": 404,
    "no_history": 422,
    "out_of_service": 422,
    "unseen_station": 422,
    "ok": 200,
}

Scorer = Callable[[DataFrame], DataFrame]


def feature_rows(
    window: DataFrame,
    stations: DataFrame,
    as_of: Column,
    *,
    lookback_minutes: int = S.LOOKBACK_MINUTES,
    spec: FeatureSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Newest feature row of every station, from rows inside the lookback only.

    The rows are cut before the features, so a stale station sees less history.
    """
    recent = lookback(window, as_of, lookback_minutes).select(*S.RAW_COLUMNS)
    capacity = stations.select(*S.STATION_KEY, "capacity")
    features = compute_features(recent, capacity, spec)
    return newest_per_key(features, S.STATION_KEY, ["observed_at"])


def gate(
    requested: DataFrame,
    stations: DataFrame,
    features: DataFrame,
    codes: DataFrame,
    *,
    model_loaded: bool = True,
) -> DataFrame:
    """Requested stations with their feature row, code and ``outcome``."""
    known = stations.select(
        *S.STATION_KEY, F.col("capacity").alias("station_capacity"), F.lit(True).alias("_known")
    )
    joined = (
        requested.select(*S.STATION_KEY)
        .distinct()
        .join(known, list(S.STATION_KEY), "left")
        .join(features, list(S.STATION_KEY), "left")
    )
    checked = encode_stations(joined, codes)
    served = F.coalesce(F.col("is_installed") & F.col("is_renting"), F.lit(False))
    outcome = (
        F.when(F.lit(not model_loaded), "no_model")
        .when(F.col("_known").isNull(), "unknown_station")
        .when(F.col("observed_at").isNull(), "no_history")
        .when(~served, "out_of_service")
        .when(F.col("station_id_code").isNull(), "unseen_station")
        .otherwise("ok")
    )
    http = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return checked.withColumn("outcome", outcome).withColumn(
        "status_code", http[F.col("outcome")]
    ).drop("_known")


def persistence(rows: DataFrame) -> DataFrame:
    """Score with no change at all."""
    return constant_change(0.0)(rows)


def constant_change(delta: float) -> Scorer:
    return lambda rows: rows.withColumn(PREDICTED_DELTA, F.lit(float(delta)))


def model_change(
    model: Model, codes: DataFrame, n_codes: int, spec: FeatureSpec = DEFAULT_SPEC
) -> Scorer:
    """Score with a trained model; stations it cannot score keep a null change."""

    def score(rows: DataFrame) -> DataFrame:
        usable = rows.where(F.col("outcome") == "ok").select(*S.STATION_KEY, *spec.columns[1:])
        scored = predict(model, model_rows(model, usable, codes, n_codes, spec))
        return rows.join(
            scored.select(*S.STATION_KEY, PREDICTED_DELTA), list(S.STATION_KEY), "left"
        )

    return score


def forecast(
    gated: DataFrame,
    scorer: Scorer,
    *,
    run_id: str,
    horizon_minutes: int = S.HORIZON_MINUTES,
) -> DataFrame:
    """Forecast record per requested station; value columns are null unless served."""
    ok = F.col("outcome") == "ok"
    total = F.col(CURRENT) + F.col(PREDICTED_DELTA)
    predicted = whole_vehicles(clip_to_capacity(total, "station_capacity"))
    return scorer(gated).select(
        *S.STATION_KEY,
        "outcome",
        "status_code",
        F.when(ok, predicted).alias("predicted_num_vehicles_available"),
        F.lit(horizon_minutes).alias("horizon_minutes"),
        F.when(ok, F.col("observed_at") + minutes(horizon_minutes)).alias("predicted_at"),
        F.when(ok, F.col("observed_at")).alias("last_observed_at"),
        F.when(ok, F.col(CURRENT)).alias("last_observed_num_vehicles_available"),
        F.lit(run_id).alias("model_run_id"),
    )


def forecast_all(
    window: DataFrame,
    history: DataFrame,
    codes: DataFrame,
    scorer: Scorer,
    as_of: Column,
    *,
    run_id: str,
    requested: DataFrame | None = None,
    lookback_minutes: int = S.LOOKBACK_MINUTES,
    horizon_minutes: int = S.HORIZON_MINUTES,
    spec: FeatureSpec = DEFAULT_SPEC,
    model_loaded: bool = True,
) -> DataFrame:
    """Forecast every station of the catalog (or the requested ones) at ``as_of``."""
    stations = newest_rows(history)
    features = feature_rows(
        window, stations, as_of, lookback_minutes=lookback_minutes, spec=spec
    )
    features = features.drop("capacity").join(
        stations.select(*S.STATION_KEY, "capacity"), list(S.STATION_KEY), "left"
    )
    gated = gate(
        stations if requested is None else requested,
        stations,
        features,
        codes,
        model_loaded=model_loaded,
    )
    return forecast(gated, scorer, run_id=run_id, horizon_minutes=horizon_minutes)
