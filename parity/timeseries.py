"""As-of lookups, trailing statistics, change logs, newest rows, splits, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import HISTORY_SQL, STATIONS_SQL, STATUS_SQL, query, with_views
from stationflow import schemas as S
from stationflow.functions import clock, measures
from stationflow.operators import changes, newest, recent
from stationflow.operators.asof import asof_join
from stationflow.operators.lookup import attach
from stationflow.plans import dataset as D
from stationflow.plans.features import (
    FeatureSpec,
    add_target,
    compute_features,
    labeled_features,
)
from stationflow.session import settle

# The given events are sparser than a 5-minute cycle, so the minutes are larger.
SPEC = FeatureSpec(
    lags=(60, 120, 240, 480), lag_tolerance=60, delta=240, means=(240, 480), stds=(240,)
)
LABEL = {"horizon_minutes": 120, "tolerance_minutes": 60}
MIN_ROWS = 150

ST, HI, CA = STATUS_SQL, HISTORY_SQL, STATIONS_SQL


def asof_sql(minutes: int, tolerance: int) -> str:
    """Lag join of ``status`` with itself as a FROM-clause fragment."""
    return f"""
  ASOF LEFT JOIN status r{minutes}
    ON l.system_id = r{minutes}.system_id AND l.station_id = r{minutes}.station_id
   AND l.observed_at - INTERVAL {minutes} MINUTE >= r{minutes}.observed_at"""


def lag_sql(minutes: int, tolerance: int) -> str:
    return (
        f"CASE WHEN r{minutes}.observed_at >= l.observed_at - INTERVAL {minutes + tolerance} MINUTE"
        f" THEN r{minutes}.num_vehicles_available END"
    )


def frame_sql(minutes: int) -> str:
    return (
        "(PARTITION BY system_id, station_id ORDER BY observed_at RANGE BETWEEN "
        f"(INTERVAL '{minutes} minutes' - INTERVAL 1 MICROSECOND) PRECEDING AND CURRENT ROW)"
    )


LOCAL = "((observed_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto')"

FEATURES_SQL = f"""
lagged AS (
  SELECT l.*, {", ".join(f"{lag_sql(m, 60)} AS lag_{m}m_vehicles" for m in SPEC.lags)}
  FROM status l {" ".join(asof_sql(m, 60) for m in SPEC.lags)}),
rolled AS (
  SELECT *, avg(num_vehicles_available) OVER {frame_sql(240)} AS roll_mean_240m,
         stddev_samp(num_vehicles_available) OVER {frame_sql(240)} AS roll_std_240m,
         avg(num_vehicles_available) OVER {frame_sql(480)} AS roll_mean_480m,
         hour({LOCAL}) AS h, isodow({LOCAL}) AS d
  FROM lagged),
features AS (
  SELECT r.system_id, r.observed_at, r.station_id, s.capacity, r.num_vehicles_available,
         r.num_docks_available,
         CASE WHEN s.capacity > 0 THEN r.num_vehicles_available / s.capacity END
           AS occupancy_ratio,
         {", ".join(f"lag_{m}m_vehicles" for m in SPEC.lags)},
         r.num_vehicles_available - lag_240m_vehicles AS delta_240m,
         roll_mean_240m, roll_std_240m, roll_mean_480m,
         sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos,
         sin(2 * pi() * d / 7) AS dow_sin, cos(2 * pi() * d / 7) AS dow_cos,
         r.is_installed, r.is_renting, r.is_returning
  FROM rolled r LEFT JOIN stations s USING (system_id, station_id))"""

ROUNDED = ("occupancy_ratio", "roll_mean_240m", "roll_std_240m", "roll_mean_480m",
           "hour_sin", "hour_cos", "dow_sin", "dow_cos")


def feature_select(*extra: str) -> str:
    """Feature columns in comparable form."""
    out = []
    for c in SPEC.output:
        if c == "observed_at":
            out.append("epoch_us(observed_at) AS observed_at")
        elif c in ROUNDED:
            out.append(f"round({c}, 6) + 0.0 AS {c}")
        else:
            out.append(c)
    return ", ".join([*out, *extra])


LABELED_SQL = """
labeled AS (
  SELECT f.*, t.observed_at AS target_observed_at,
         t.num_vehicles_available AS target_num_vehicles_available
  FROM features f ASOF JOIN status t
    ON f.system_id = t.system_id AND f.station_id = t.station_id
   AND f.observed_at + INTERVAL 120 MINUTE <= t.observed_at
  WHERE t.observed_at <= f.observed_at + INTERVAL 180 MINUTE
    AND t.num_vehicles_available IS NOT NULL)"""

FILTERED_SQL = """
served AS (SELECT * FROM labeled WHERE is_installed AND is_renting),
filtered AS (
  SELECT * FROM served WHERE (system_id, station_id) IN (
    SELECT (system_id, station_id) FROM served
    GROUP BY system_id, station_id HAVING count(*) >= 150))"""

CUTOFFS_SQL = """
ranked AS (
  SELECT observed_at, row_number() OVER (ORDER BY observed_at) - 1 AS k,
         count(*) OVER () AS n FROM filtered),
cutoffs AS (
  SELECT max(CASE WHEN k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN observed_at END)
           AS train_cutoff,
         max(CASE WHEN k = CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT)
                  THEN observed_at END) AS val_cutoff
  FROM ranked),
split AS (
  SELECT f.*, CASE WHEN observed_at < train_cutoff THEN 'train'
                   WHEN observed_at < val_cutoff THEN 'val' ELSE 'test' END AS split
  FROM filtered f, cutoffs)"""

TARGET_COLUMNS = ("epoch_us(target_observed_at) AS target_observed_at",
                  "target_num_vehicles_available")

TO_FEATURES = with_views(ST, HI, CA, FEATURES_SQL)
TO_LABELED = with_views(ST, HI, CA, FEATURES_SQL, LABELED_SQL)
TO_FILTERED = with_views(ST, HI, CA, FEATURES_SQL, LABELED_SQL, FILTERED_SQL)
TO_SPLIT = with_views(ST, HI, CA, FEATURES_SQL, LABELED_SQL, FILTERED_SQL, CUTOFFS_SQL)


def catalog(v):
    return newest.current_capacity(v.history)


def labeled(v):
    return labeled_features(v.status, catalog(v), SPEC, **LABEL)


def filtered(v):
    return D.apply_quality_filters(labeled(v), MIN_ROWS)


def training_rows(v):
    """Filtered rows, computed once: the cutoffs and the split both read them."""
    return settle(
        filtered(v).select(
            *S.IDENTITY, "num_vehicles_available", "target_num_vehicles_available", "roll_mean_480m"
        )
    )


# --- features and labels -----------------------------------------------------


@query("features", f"{TO_FEATURES} SELECT {feature_select()} FROM features")
def _(v):
    return compute_features(v.status, catalog(v), SPEC)


@query("labeled_features", f"{TO_LABELED} SELECT {feature_select(*TARGET_COLUMNS)} FROM labeled")
def _(v):
    return labeled(v)


@query("add_target", f"{TO_LABELED} SELECT {feature_select(*TARGET_COLUMNS)} FROM labeled")
def _(v):
    return add_target(compute_features(v.status, catalog(v), SPEC), v.status, **LABEL)


@query(
    "asof_lag",
    f"{with_views(ST)} SELECT l.system_id, l.station_id, epoch_us(l.observed_at) AS observed_at,"
    f" {', '.join(f'{lag_sql(m, 60)} AS lag_{m}m_vehicles' for m in SPEC.lags)}"
    f" FROM status l {' '.join(asof_sql(m, 60) for m in SPEC.lags)}",
)
def _(v):
    lags = [f"lag_{m}m_vehicles" for m in SPEC.lags]
    return compute_features(v.status, catalog(v), SPEC).select(*S.IDENTITY, *lags)


def _between(v, strategy):
    return asof_join(
        v.status.select(*S.IDENTITY),
        v.history.where("is_charging_station"),
        by=S.STATION_KEY,
        left_time="observed_at",
        right_time="observed_at",
        values={"capacity": "seen_capacity", "address": "seen_address"},
        strategy=strategy,
        tolerance_minutes=240,
        matched_time="seen_at",
    )


def _between_sql(sign: str) -> str:
    near = (
        "h.observed_at >= l.observed_at - INTERVAL 240 MINUTE"
        if sign == ">="
        else "h.observed_at <= l.observed_at + INTERVAL 240 MINUTE"
    )
    return f"""{with_views(ST, HI)}, charging AS (SELECT * FROM history WHERE is_charging_station)
SELECT l.system_id, l.station_id, epoch_us(l.observed_at) AS observed_at,
       CASE WHEN {near} THEN epoch_us(h.observed_at) END AS seen_at,
       CASE WHEN {near} THEN h.capacity END AS seen_capacity,
       CASE WHEN {near} THEN h.address END AS seen_address
FROM status l ASOF LEFT JOIN charging h
  ON l.system_id = h.system_id AND l.station_id = h.station_id
 AND l.observed_at {sign} h.observed_at"""


@query("asof_between_tables_backward", _between_sql(">="))
def _(v):
    return _between(v, "backward")


@query("asof_between_tables_forward", _between_sql("<="))
def _(v):
    return _between(v, "forward")


@query(
    "trailing_statistics",
    f"{with_views(ST)} SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,"
    f" round(avg(num_vehicles_available) OVER {frame_sql(240)}, 6) AS roll_mean_240m,"
    f" round(stddev_samp(num_vehicles_available) OVER {frame_sql(240)}, 6) AS roll_std_240m,"
    f" round(avg(num_vehicles_available) OVER {frame_sql(480)}, 6) AS roll_mean_480m FROM status",
)
def _(v):
    return compute_features(v.status, catalog(v), SPEC).select(*S.IDENTITY, *SPEC.rolling_columns)


@query(
    "local_calendar",
    f"""{with_views(ST)}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       epoch_us({LOCAL}) AS local_time, CAST(hour({LOCAL}) AS INTEGER) AS local_hour,
       CAST(isodow({LOCAL}) AS INTEGER) AS local_weekday,
       round(sin(2 * pi() * hour({LOCAL}) / 24), 6) + 0.0 AS hour_sin,
       round(cos(2 * pi() * hour({LOCAL}) / 24), 6) + 0.0 AS hour_cos,
       round(sin(2 * pi() * isodow({LOCAL}) / 7), 6) + 0.0 AS dow_sin,
       round(cos(2 * pi() * isodow({LOCAL}) / 7), 6) + 0.0 AS dow_cos
FROM status""",
)
def _(v):
    zone = S.LOCAL_ZONE
    hour, weekday = clock.local_hour("observed_at", zone), clock.local_weekday("observed_at", zone)
    hour_sin, hour_cos = clock.cycle_position(hour, 24)
    dow_sin, dow_cos = clock.cycle_position(weekday, 7)
    return v.status.select(
        *S.IDENTITY,
        clock.to_local("observed_at", zone).alias("local_time"),
        hour.alias("local_hour"),
        weekday.alias("local_weekday"),
        hour_sin.alias("hour_sin"),
        hour_cos.alias("hour_cos"),
        dow_sin.alias("dow_sin"),
        dow_cos.alias("dow_cos"),
    )


@query(
    "capacity_lookup",
    f"""{with_views(ST, HI, CA)}
SELECT l.system_id, l.station_id, epoch_us(l.observed_at) AS observed_at, s.capacity,
       round(CASE WHEN s.capacity > 0 THEN l.num_vehicles_available / s.capacity END, 6)
         AS occupancy_ratio
FROM status l LEFT JOIN stations s USING (system_id, station_id)""",
)
def _(v):
    return attach(v.status, catalog(v), S.STATION_KEY).select(
        *S.IDENTITY,
        "capacity",
        measures.occupancy_ratio("num_vehicles_available", "capacity").alias("occupancy_ratio"),
    )


# --- change log --------------------------------------------------------------

TRACKED = S.TRACKED_STATION_FIELDS
DAY_WINDOW = "(PARTITION BY system_id, station_id, CAST(observed_at AS DATE) ORDER BY observed_at)"
CHANGED = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER {DAY_WINDOW}" for c in TRACKED)
FIRST = "observed_at = min(observed_at) OVER (PARTITION BY system_id, station_id, CAST(observed_at AS DATE))"
HISTORY_COLUMNS = ", ".join(
    "epoch_us(observed_at) AS observed_at"
    if c == "observed_at"
    else (f"round({c}, 6) AS {c}" if c in ("lat", "lon") else c)
    for c in S.STATIONS_SCHEMA.fieldNames()
)


@query(
    "change_log_collapse",
    f"{with_views(HI)} SELECT {HISTORY_COLUMNS} FROM history QUALIFY ({CHANGED}) OR {FIRST}",
)
def _(v):
    return changes.collapse_changes(v.history)


@query(
    "change_detection",
    f"""{with_views(HI)}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       lag(capacity) OVER {DAY_WINDOW} AS previous_capacity,
       lag(address) OVER {DAY_WINDOW} AS previous_address,
       ({CHANGED}) AS changed
FROM history""",
)
def _(v):
    marked = changes.with_previous(v.history, TRACKED)
    return marked.select(
        *S.IDENTITY,
        F.col("_previous.capacity").alias("previous_capacity"),
        F.col("_previous.address").alias("previous_address"),
        (~F.col("_now").eqNullSafe(F.col("_previous"))).alias("changed"),
    )


@query(
    "first_of_day",
    f"{with_views(HI)} SELECT {HISTORY_COLUMNS} FROM history QUALIFY {FIRST}",
)
def _(v):
    return changes.first_of_day(v.history)


# --- newest rows -------------------------------------------------------------


@query(
    "newest_station_rows",
    f"""{with_views(HI)} SELECT {HISTORY_COLUMNS} FROM history
QUALIFY row_number() OVER (PARTITION BY system_id, station_id ORDER BY observed_at DESC) = 1""",
)
def _(v):
    return newest.newest_rows(v.history)


@query("station_catalog", f"{with_views(HI, CA)} SELECT * FROM stations")
def _(v):
    return catalog(v)


@query(
    "newest_feature_row",
    f"""{TO_FEATURES} SELECT {feature_select()} FROM features
QUALIFY row_number() OVER (PARTITION BY system_id, station_id
                           ORDER BY features.observed_at DESC) = 1""",
)
def _(v):
    return newest.newest_per_key(
        compute_features(v.status, catalog(v), SPEC), S.STATION_KEY, ["observed_at"]
    )


@query(
    "keep_last_replay",
    f"""{with_views(ST)}, replayed AS (
  SELECT *, 0 AS source FROM status
  UNION ALL BY NAME
  SELECT * REPLACE (num_vehicles_available + 1 AS num_vehicles_available), 1 AS source
  FROM status WHERE is_renting)
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at, num_vehicles_available, source
FROM replayed
QUALIFY row_number() OVER (PARTITION BY system_id, station_id, observed_at
                           ORDER BY source DESC) = 1""",
)
def _(v):
    first = v.status.withColumn("source", F.lit(0))
    again = v.status.where("is_renting").withColumns(
        {"num_vehicles_available": F.col("num_vehicles_available") + 1, "source": F.lit(1)}
    )
    return newest.keep_last(first.unionByName(again), ["source"]).select(
        *S.IDENTITY, "num_vehicles_available", "source"
    )


@query(
    "newest_order_per_customer",
    """SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS o_orderdate, o_orderstatus
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
                                       ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(v):
    orders = v.table("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return newest.newest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# --- window of recent rows ---------------------------------------------------


@query(
    "recent_window",
    f"""{with_views(ST)}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at, num_vehicles_available
FROM status
WHERE observed_at >= (SELECT max(observed_at) FROM status) - INTERVAL 2880 MINUTE""",
)
def _(v):
    return recent.trim_to_window(v.status, 2880).select(*S.IDENTITY, "num_vehicles_available")


# --- dataset -----------------------------------------------------------------


@query(
    "quality_filter",
    f"{TO_FILTERED} SELECT {feature_select(*TARGET_COLUMNS)} FROM filtered",
)
def _(v):
    return filtered(v)


@query(
    "rows_per_station",
    f"{with_views(ST)} SELECT system_id, station_id, count(*) AS n FROM status GROUP BY ALL",
)
def _(v):
    return D.station_rows(v.status)


@query(
    "split_cutoffs",
    f"""{TO_SPLIT} SELECT epoch_us(train_cutoff) AS train_cutoff,
       epoch_us(val_cutoff) AS val_cutoff FROM cutoffs""",
)
def _(v):
    return D.split_cutoffs(training_rows(v))


@query(
    "time_split",
    f"""{TO_SPLIT} SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       num_vehicles_available, target_num_vehicles_available, split FROM split""",
)
def _(v):
    return D.time_split(training_rows(v)).select(
        *S.IDENTITY, "num_vehicles_available", "target_num_vehicles_available", "split"
    )


@query(
    "lineitem_ship_cutoffs",
    """WITH ranked AS (
  SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) - 1 AS k, count(*) OVER () AS n
  FROM lineitem)
SELECT epoch_us(max(CASE WHEN k = CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN l_shipdate END))
         AS train_cutoff,
       epoch_us(max(CASE WHEN k = CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT)
                         THEN l_shipdate END)) AS val_cutoff
FROM ranked""",
)
def _(v):
    return D.split_cutoffs(v.table("lineitem").withColumnRenamed("l_shipdate", "observed_at"))


@query(
    "persistence_metrics",
    f"""{TO_SPLIT}
SELECT split,
       round(avg(abs(target_num_vehicles_available - num_vehicles_available)), 6) AS mae,
       round(sqrt(avg(power(target_num_vehicles_available - num_vehicles_available, 2))), 6)
         AS rmse,
       count(*) AS n_rows
FROM split GROUP BY split""",
)
def _(v):
    return D.split_metrics(D.time_split(training_rows(v)))


@query(
    "improvement_over_baseline",
    f"""{TO_SPLIT}, errors AS (
  SELECT split, avg(abs(target_num_vehicles_available - num_vehicles_available)) AS baseline_mae,
         avg(abs(target_num_vehicles_available - roll_mean_480m)) AS model_mae
  FROM split GROUP BY split)
SELECT split, round(baseline_mae, 6) AS baseline_mae, round(model_mae, 6) AS model_mae,
       round((baseline_mae - model_mae) / baseline_mae * 100, 6) AS improvement_pct
FROM errors""",
)
def _(v):
    split = D.time_split(training_rows(v))
    return D.compare_to_baseline(
        D.split_metrics(split), D.split_metrics(split, "roll_mean_480m")
    )


@query(
    "run_parameters",
    f"""{TO_SPLIT}
SELECT 120 AS horizon_minutes, 60 AS target_tolerance_minutes, 150 AS min_station_history_rows,
       epoch_us(min(observed_at)) AS train_start, epoch_us(any_value(train_cutoff)) AS train_end,
       epoch_us(any_value(train_cutoff)) AS val_start, epoch_us(any_value(val_cutoff)) AS val_end,
       epoch_us(any_value(val_cutoff)) AS test_start, epoch_us(max(observed_at)) AS test_end,
       count(*) FILTER (split = 'train') AS n_train_rows,
       count(*) FILTER (split = 'val') AS n_val_rows,
       count(*) FILTER (split = 'test') AS n_test_rows,
       count(DISTINCT (system_id, station_id)) FILTER (split = 'train') AS n_stations
FROM split, cutoffs""",
)
def _(v):
    rows = training_rows(v)
    cutoffs = D.split_cutoffs(rows)
    return D.run_parameters(
        D.time_split(rows, cutoffs),
        cutoffs,
        horizon_minutes=LABEL["horizon_minutes"],
        tolerance_minutes=LABEL["tolerance_minutes"],
        min_rows=MIN_ROWS,
    )


BUSIEST_SQL = """
busiest AS (
  SELECT system_id, station_id, count(*) AS n FROM split WHERE split = 'test'
  GROUP BY ALL ORDER BY n DESC, system_id, station_id LIMIT 1)"""


@query("busiest_test_station", f"{TO_SPLIT}, {BUSIEST_SQL.strip()} SELECT * FROM busiest")
def _(v):
    return D.busiest_test_station(D.time_split(training_rows(v)))


@query(
    "busiest_station_series",
    f"""{TO_SPLIT}, {BUSIEST_SQL.strip()}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       target_num_vehicles_available AS actual, num_vehicles_available AS persistence
FROM split JOIN busiest USING (system_id, station_id) WHERE split = 'test'""",
)
def _(v):
    split = D.time_split(training_rows(v))
    return D.station_series(split, D.busiest_test_station(split))


@query(
    "delta_target",
    f"""{TO_FILTERED} SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       target_num_vehicles_available - num_vehicles_available AS target_delta FROM filtered""",
)
def _(v):
    return D.with_delta(filtered(v)).select(*S.IDENTITY, "target_delta")
