"""Model frames, serving gate and forecasts; trained models are checked by rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import CODES_SQL, HISTORY_SQL, STATIONS_SQL, STATUS_SQL, query, with_views
from parity.timeseries import FEATURES_SQL, LABEL, MIN_ROWS, SPEC, catalog
from stationflow import schemas as S
from stationflow.functions.clock import minutes
from stationflow.operators.newest import newest_rows
from stationflow.plans import boosting as B
from stationflow.plans import dataset as D
from stationflow.plans import forecast as P
from stationflow.plans import train as T
from stationflow.plans.features import compute_features, labeled_features
from stationflow.session import settle

LOOKBACK = 2880
SETTINGS = T.TreeSettings()
LEAVES = B.LeafSettings(rounds=20, patience=10)

NUMERIC = SPEC.columns[1:]
MODEL_OUT = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in NUMERIC)


def codes(v):
    """Codes of the catalog, without one station the model then has never seen."""
    return D.station_codes(v.history.where("station_id <> '7'"))


@query(
    "model_frame",
    f"""{with_views(STATUS_SQL, HISTORY_SQL, STATIONS_SQL, FEATURES_SQL, CODES_SQL)}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at, station_id_code, {MODEL_OUT}
FROM features LEFT JOIN codes USING (system_id, station_id)""",
)
def _(v):
    features = compute_features(v.status, catalog(v), SPEC)
    return D.model_frame(features, codes(v), SPEC, keep=S.IDENTITY)


AS_OF = "(SELECT max(observed_at) + INTERVAL 10 MINUTE FROM status)"
GATE_SQL = f"""
current AS (
  SELECT * FROM history
  QUALIFY row_number() OVER (PARTITION BY system_id, station_id ORDER BY observed_at DESC) = 1),
last AS (
  SELECT system_id, station_id, observed_at AS seen_at, num_vehicles_available, is_installed,
         is_renting
  FROM status WHERE observed_at >= {AS_OF} - INTERVAL 2880 MINUTE
    AND NOT (system_id = 'sys-a' AND station_id = '5')
  QUALIFY row_number() OVER (PARTITION BY system_id, station_id ORDER BY observed_at DESC) = 1),
requested AS (
  SELECT DISTINCT system_id, station_id FROM history
  UNION SELECT 'sys-a', CAST(c_nationkey AS VARCHAR) FROM customer),
gated AS (
  SELECT r.system_id, r.station_id, c.capacity, l.seen_at, l.num_vehicles_available,
         CASE WHEN c.system_id IS NULL THEN 'unknown_station'
              WHEN l.seen_at IS NULL THEN 'no_history'
              WHEN NOT (is_installed AND is_renting) THEN 'out_of_service'
              WHEN k.station_id_code IS NULL THEN 'unseen_station' ELSE 'ok' END AS outcome
  FROM requested r LEFT JOIN current c USING (system_id, station_id)
  LEFT JOIN last l USING (system_id, station_id)
  LEFT JOIN codes k USING (system_id, station_id)),
answered AS (
  SELECT *, CASE outcome WHEN 'ok' THEN 200 WHEN 'unknown_station' THEN 404 ELSE 422 END
            AS status_code FROM gated)"""
TO_GATE = with_views(STATUS_SQL, HISTORY_SQL, CODES_SQL, GATE_SQL)


def as_of(v):
    return v.status.agg(F.max("observed_at") + minutes(10)).scalar()


def served(v):
    """Status rows without one station, which then has no history."""
    return v.status.where("NOT (system_id = 'sys-a' AND station_id = '5')")


def requested(v):
    asked = v.table("customer").select(
        F.lit("sys-a").alias("system_id"), F.col("c_nationkey").cast("string").alias("station_id")
    )
    return v.history.select(*S.STATION_KEY).union(asked).distinct()


@query(
    "serving_gate",
    f"{TO_GATE} SELECT system_id, station_id, outcome, status_code FROM answered",
)
def _(v):
    stations = newest_rows(v.history)
    rows = P.feature_rows(served(v), stations, as_of(v), lookback_minutes=LOOKBACK, spec=SPEC)
    return P.gate(requested(v), stations, rows, codes(v)).select(
        *S.STATION_KEY, "outcome", "status_code"
    )


def forecast_sql(delta: float) -> str:
    value = f"greatest(0.0::DOUBLE, num_vehicles_available + {delta}::DOUBLE)"
    clipped = f"CASE WHEN capacity IS NULL THEN {value} ELSE least({value}, capacity) END"
    return f"""{TO_GATE}
SELECT system_id, station_id, outcome, status_code,
       CASE WHEN outcome = 'ok' THEN CAST(round_even({clipped}, 0) AS BIGINT) END
         AS predicted_num_vehicles_available,
       120 AS horizon_minutes,
       CASE WHEN outcome = 'ok' THEN epoch_us(seen_at + INTERVAL 120 MINUTE) END AS predicted_at,
       CASE WHEN outcome = 'ok' THEN epoch_us(seen_at) END AS last_observed_at,
       CASE WHEN outcome = 'ok' THEN num_vehicles_available END
         AS last_observed_num_vehicles_available,
       'run-1' AS model_run_id
FROM answered"""


def _forecast(v, scorer, known=None):
    return P.forecast_all(
        served(v),
        v.history,
        codes(v) if known is None else known,
        scorer,
        as_of(v),
        run_id="run-1",
        requested=requested(v),
        lookback_minutes=LOOKBACK,
        spec=SPEC,
    )


@query("forecast_persistence", forecast_sql(0))
def _(v):
    return _forecast(v, P.persistence)


@query("forecast_half_vehicle_more", forecast_sql(0.5))
def _(v):
    """Every unclipped forecast ends in a half and is rounded to even."""
    return _forecast(v, P.constant_change(0.5))


@query(
    "forecast_without_model",
    f"""{TO_GATE} SELECT system_id, station_id, 'no_model' AS outcome, 503 AS status_code
FROM answered""",
)
def _(v):
    stations = newest_rows(v.history)
    rows = P.feature_rows(served(v), stations, as_of(v), lookback_minutes=LOOKBACK, spec=SPEC)
    return P.gate(requested(v), stations, rows, codes(v), model_loaded=False).select(
        *S.STATION_KEY, "outcome", "status_code"
    )


# --- trained models ----------------------------------------------------------


def _prepared(v, settings):
    """Split rows as the booster takes them, the codes and their number."""
    labeled = settle(labeled_features(v.status, catalog(v), SPEC, **LABEL))
    rows = settle(D.with_delta(D.apply_quality_filters(labeled, MIN_ROWS)))
    split = D.time_split(rows)
    known = D.station_codes(v.history)
    n = known.count()
    return settle(T.training_rows(settings, split, known, n, SPEC)), known, n


def _fitted(v):
    """Split and assembled rows, the codes, and a small model on them."""
    assembled, known, n = _prepared(v, SETTINGS)
    return assembled, known, n, T.fit(assembled, n, SETTINGS)


@query("boosted_metrics")
def _(v):
    assembled, _, _, model = _fitted(v)
    return D.split_metrics(T.predict(model, assembled), T.PREDICTED)


@query("boosted_round_history")
def _(v):
    assembled, _, _, model = _fitted(v)
    return T.round_history(model, assembled)


@query("boosted_forecast")
def _(v):
    _, known, n, model = _fitted(v)
    return _forecast(v, P.model_change(model, known, n, SPEC), known)


@query("boosted_against_baseline")
def _(v):
    assembled, _, _, model = _fitted(v)
    persistence = assembled.withColumnRenamed("current_vehicles", D.CURRENT)
    scored = T.predict(model, assembled)
    return D.compare_to_baseline(
        D.split_metrics(persistence), D.split_metrics(scored, T.PREDICTED)
    )


@query("leafwise_metrics")
def _(v):
    rows, _, _ = _prepared(v, LEAVES)
    return D.split_metrics(T.predict(B.fit(rows, LEAVES, SPEC), rows), T.PREDICTED)


@query("leafwise_forecast")
def _(v):
    rows, known, n = _prepared(v, LEAVES)
    model = B.fit(rows, LEAVES, SPEC)
    return _forecast(v, P.model_change(model, known, n, SPEC), known)
