"""Reads, typed frames, day sets, windows, volume and readiness reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parity.registry import HISTORY_SQL, STATUS_SQL, query, with_views
from stationflow import schemas as S
from stationflow.functions import clock
from stationflow.operators import contract, days, newest, recent
from stationflow.plans import monitor
from stationflow.sources import sinks, tables

ST, HI = STATUS_SQL, HISTORY_SQL
UTC = dt.timezone.utc
DAY = dt.date(2024, 1, 10)
SINCE = dt.datetime(2024, 1, 20, tzinfo=UTC)
TODAY = dt.date(2024, 1, 25)
START = dt.date(2024, 1, 5)

STATUS_OUT = ", ".join(
    "epoch_us(observed_at) AS observed_at" if c == "observed_at" else c
    for c in S.STATUS_SCHEMA.fieldNames()
)
RAW_OUT = ", ".join(
    "epoch_us(observed_at) AS observed_at" if c == "observed_at" else c for c in S.RAW_COLUMNS
)
HISTORY_OUT = ", ".join(
    "epoch_us(observed_at) AS observed_at"
    if c == "observed_at"
    else (f"round({c}, 6) AS {c}" if c in ("lat", "lon") else c)
    for c in S.STATIONS_SCHEMA.fieldNames()
)
ON_DAY = "observed_at >= TIMESTAMP '2024-01-10' AND observed_at < TIMESTAMP '2024-01-11'"


# --- reads -------------------------------------------------------------------


@query("typed_status", f"{with_views(ST)} SELECT {STATUS_OUT} FROM status")
def _(v):
    return contract.conform(v.status, S.STATION_STATUS)


@query("typed_stations", f"{with_views(HI)} SELECT {HISTORY_OUT} FROM history")
def _(v):
    return contract.conform(v.history, S.STATIONS)


@query("day_rows", f"{with_views(ST)} SELECT {STATUS_OUT} FROM status WHERE {ON_DAY}")
def _(v):
    return tables.day_rows(v.status, DAY)


@query("staged_day_rows", f"{with_views(HI)} SELECT {HISTORY_OUT} FROM history WHERE {ON_DAY}")
def _(v):
    staged = v.history.withColumn("date", clock.utc_day("observed_at"))
    return staged.where(F.col("date") == F.lit(DAY)).drop("date").orderBy("observed_at")


@query(
    "system_history",
    f"{with_views(ST)} SELECT {RAW_OUT} FROM status WHERE system_id = 'sys-a'",
)
def _(v):
    return tables.status_history(v.status, "sys-a")


@query(
    "system_history_since",
    f"""{with_views(ST)} SELECT {RAW_OUT} FROM status
WHERE system_id = 'sys-b' AND observed_at >= TIMESTAMP '2024-01-20'""",
)
def _(v):
    return tables.status_history(v.status, "sys-b", since=SINCE)


@query(
    "station_history",
    f"{with_views(HI)} SELECT {HISTORY_OUT} FROM history WHERE system_id = 'sys-a'",
)
def _(v):
    return tables.station_history(v.history, "sys-a")


@query(
    "system_catalog",
    f"""{with_views(HI)} SELECT system_id, station_id,
       arg_max_null(capacity, observed_at) AS capacity
FROM history WHERE system_id = 'sys-b' GROUP BY ALL""",
)
def _(v):
    return tables.station_catalog(v.history, "sys-b")


@query(
    "latest_stations",
    f"""{with_views(HI)} SELECT {HISTORY_OUT} FROM history WHERE system_id = 'sys-a'
QUALIFY history.observed_at = max(history.observed_at) OVER (PARTITION BY station_id)""",
)
def _(v):
    return tables.latest_stations(v.history, "sys-a")


@query(
    "station_details",
    f"""{with_views(HI)} SELECT {HISTORY_OUT} FROM history
WHERE system_id = 'sys-a' AND station_id = '4' ORDER BY history.observed_at DESC LIMIT 1""",
)
def _(v):
    return tables.station_details(v.history, "sys-a", "4")


@query(
    "recent_status",
    f"""{with_views(ST)} SELECT {STATUS_OUT} FROM status
WHERE system_id = 'sys-a' AND station_id = '4' AND observed_at >= TIMESTAMP '2024-01-20'""",
)
def _(v):
    return tables.recent_status(v.status, "sys-a", "4", SINCE)


@query(
    "latest_status_time",
    f"""{with_views(ST)} SELECT max(epoch_us(observed_at)) AS observed_at FROM status
WHERE system_id = 'sys-b'""",
)
def _(v):
    return tables.latest_status_time(v.status, "sys-b")


@query("system_ids", f"{with_views(HI)} SELECT DISTINCT system_id FROM history")
def _(v):
    return contract.system_ids(v.history)


@query(
    "strict_union",
    f"""{with_views(ST)} SELECT {STATUS_OUT} FROM status WHERE system_id = 'sys-a'
UNION ALL SELECT {STATUS_OUT} FROM status WHERE is_renting""",
)
def _(v):
    status = v.status
    return contract.union_strict(status.where("system_id = 'sys-a'"), status.where("is_renting"))


@query(
    "repeated_identities",
    """SELECT o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS copies
FROM orders GROUP BY ALL HAVING count(*) > 1""",
)
def _(v):
    orders = v.table("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return contract.duplicate_keys(orders, ["o_custkey", "day"])


@query(
    "snapshot_keys",
    f"""{with_views(ST)}
SELECT system_id, station_id, epoch_us(observed_at) AS observed_at,
       'snapshots/station_status/date=' || strftime(observed_at, '%Y-%m-%d') || '/'
         || strftime(observed_at, '%Y%m%dT%H%M%SZ') || '.parquet' AS key
FROM status""",
)
def _(v):
    return v.status.select(*S.IDENTITY, sinks.snapshot_key(S.STATION_STATUS).alias("key"))


# --- windows -----------------------------------------------------------------


@query(
    "window_merge",
    f"""{with_views(ST)}, tagged AS (
  SELECT *, 0 AS source FROM status WHERE observed_at < TIMESTAMP '2024-01-29'
  UNION ALL
  SELECT * REPLACE (num_docks_available + 1 AS num_docks_available), 1 AS source
  FROM status WHERE observed_at >= TIMESTAMP '2024-01-28'),
kept AS (
  SELECT * FROM tagged QUALIFY row_number() OVER (
    PARTITION BY system_id, station_id, observed_at ORDER BY source DESC) = 1)
SELECT {STATUS_OUT} FROM kept
WHERE observed_at >= (SELECT max(observed_at) FROM kept) - INTERVAL 4320 MINUTE""",
)
def _(v):
    status = v.status
    window = status.where(F.col("observed_at") < clock.instant("2024-01-29T00:00:00+00:00"))
    fresh = status.where(
        F.col("observed_at") >= clock.instant("2024-01-28T00:00:00+00:00")
    ).withColumn("num_docks_available", F.col("num_docks_available") + 1)
    return sinks.merge_window(window, fresh, 4320)


@query(
    "current_stations",
    f"""{with_views(HI)} SELECT {HISTORY_OUT} FROM history
QUALIFY history.observed_at = max(history.observed_at) OVER (PARTITION BY system_id)""",
)
def _(v):
    return sinks.current_stations(v.history.where("capacity = 0"), v.history)


@query(
    "observed_bounds",
    f"""{with_views(ST)} SELECT min(epoch_us(observed_at)) AS oldest,
       max(epoch_us(observed_at)) AS newest FROM status""",
)
def _(v):
    return recent.observed_bounds(v.status)


@query(
    "history_span",
    f"""{with_views(ST)}
SELECT round((max(epoch_us(observed_at)) - min(epoch_us(observed_at))) / 1e6, 6) AS span_seconds
FROM status""",
)
def _(v):
    return recent.history_span(v.status)


@query(
    "covers_lookback",
    f"""{with_views(ST)}
SELECT coalesce(max(observed_at) - min(observed_at) >= INTERVAL 90 MINUTE, FALSE) AS covered
FROM status""",
)
def _(v):
    return recent.covers_lookback(v.status)


@query(
    "newest_time_per_station",
    f"""{with_views(ST)} SELECT system_id, station_id, max(epoch_us(observed_at)) AS observed_at
FROM status GROUP BY ALL""",
)
def _(v):
    return newest.last_time(v.status)


# --- days --------------------------------------------------------------------

PRESENT = "present AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)"
ARCHIVED = """archived AS (
  SELECT CAST(ts AS DATE) AS day FROM events GROUP BY ALL
  HAVING count(*) FILTER (event_type = 'purchase') > count(*) FILTER (event_type = 'view'))"""


def _present(v):
    return days.days_present(v.status)


def _archived(v):
    """Days with more purchases than views stand for those already published."""
    kind = F.col("event_type")
    per_day = v.table("events").groupBy(clock.utc_day("ts").alias("day")).agg(
        F.count_if(kind == "purchase").alias("bought"), F.count_if(kind == "view").alias("seen")
    )
    return per_day.where("bought > seen").select("day")


@query(
    "days_present",
    f"WITH {PRESENT} SELECT strftime(day, '%Y-%m-%d') AS day FROM present",
)
def _(v):
    return _present(v).orderBy("day")


@query(
    "observed_day_range",
    f"""WITH {PRESENT} SELECT strftime(min(day), '%Y-%m-%d') AS first_day,
       strftime(max(day), '%Y-%m-%d') AS last_day FROM present""",
)
def _(v):
    return days.observed_day_range(v.status)


@query(
    "staged_days_of_keys",
    """SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE event_type IN ('signup', 'error')""",
)
def _(v):
    """Keys of other tables, malformed days and other file types are skipped."""
    kind, day = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")
    key = (
        F.when(kind == "view", F.concat(F.lit("snapshots/stations/date="), day, F.lit("/a.parquet")))
        .when(kind == "click", F.lit("snapshots/station_status/date=2024-13-45/a.parquet"))
        .when(kind == "purchase", F.concat(F.lit("snapshots/station_status/date="), day, F.lit("/a.json")))
        .otherwise(
            F.concat(F.lit("snapshots/station_status/date="), day, F.lit("/"),
                     clock.cycle_stamp("ts"), F.lit(".parquet"))
        )
    )
    return days.staged_days(v.table("events").select(key.alias("key")), S.STATION_STATUS)


NEEDED = """needed AS (
  SELECT day FROM present WHERE day < DATE '2024-01-25' AND day >= DATE '2024-01-05'
  EXCEPT SELECT day FROM archived)"""


@query(
    "days_needing_export",
    f"WITH {PRESENT}, {ARCHIVED}, {NEEDED} SELECT strftime(day, '%Y-%m-%d') AS day FROM needed",
)
def _(v):
    return days.days_needing_export(_present(v), _archived(v), today=TODAY, start=START)


@query(
    "backfill_plan",
    f"""WITH {PRESENT} SELECT strftime(day, '%Y-%m-%d') AS day FROM present
WHERE day < DATE '2024-01-25'""",
)
def _(v):
    return days.plan_export(_present(v), _archived(v), today=TODAY, backfill=True)


@query(
    "export_gap_report",
    f"""WITH {PRESENT}, {ARCHIVED}, {NEEDED}
SELECT count(*) AS missing_days,
       count(*) > 1 AND (SELECT count(*) > 0 FROM archived) AS warn FROM needed""",
)
def _(v):
    present, archived = _present(v), _archived(v)
    missing = days.plan_export(present, archived, today=TODAY, start=START)
    return days.gap_report(missing, archived)


SAFE = """safe AS (
  SELECT day FROM present INTERSECT SELECT day FROM archived)"""


@query(
    "days_safe_to_trim",
    f"""WITH {PRESENT}, {ARCHIVED}, {SAFE} SELECT strftime(day, '%Y-%m-%d') AS day FROM safe
WHERE day < DATE '2024-01-18'""",
)
def _(v):
    return days.days_safe_to_trim(_present(v), _archived(v), today=TODAY, keep_days=7)


@query(
    "rows_after_retention",
    f"""{with_views(ST)}, {PRESENT}, {ARCHIVED}, {SAFE}
SELECT {STATUS_OUT} FROM status
WHERE CAST(observed_at AS DATE) NOT IN (SELECT day FROM safe WHERE day < DATE '2024-01-18')""",
)
def _(v):
    safe = days.days_safe_to_trim(_present(v), _archived(v), today=TODAY, keep_days=7)
    return days.without_days(v.status, safe)


STATE_CHANGE = " OR ".join(
    f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in S.TRACKED_STATION_FIELDS
)


@query(
    "archived_rows_per_table",
    f"""{with_views(ST, HI)}, marked AS (
  SELECT {STATE_CHANGE} OR row_number() OVER w = 1 AS kept FROM history
  WINDOW w AS (PARTITION BY system_id, station_id, CAST(observed_at AS DATE)
               ORDER BY observed_at))
SELECT 'station_status' AS "table", count(*) AS rows FROM status
UNION ALL
SELECT 'stations', count(*) FROM marked WHERE kept""",
)
def _(v):
    return monitor.rows_per_table(
        {
            S.STATION_STATUS: sinks.archive_form(v.status, S.STATION_STATUS),
            S.STATIONS: sinks.archive_form(v.history, S.STATIONS),
        }
    )


# --- readiness ---------------------------------------------------------------


@query(
    "readiness",
    f"""{with_views(ST)}, extent AS (
  SELECT min(epoch_us(observed_at)) AS oldest, max(epoch_us(observed_at)) AS newest FROM status)
SELECT TRUE AS model_loaded, 'run-1' AS model_run_id, TRUE AS storage_reachable,
       newest AS latest_observed_at, 3000.0::DOUBLE AS data_age_seconds,
       5400.0::DOUBLE AS max_data_age_seconds,
       round((newest - oldest) / 1e6, 6) AS history_span_seconds,
       5400.0::DOUBLE AS required_history_seconds, TRUE AS data_fresh,
       (newest - oldest) / 1e6 >= 5400 AS history_deep_enough,
       CASE WHEN (newest - oldest) / 1e6 >= 5400 THEN 'ready' ELSE 'not_ready' END AS status
FROM extent""",
)
def _(v):
    as_of = v.status.agg(F.max("observed_at") + clock.minutes(50)).scalar()
    return monitor.readiness(v.status, as_of, model_run_id="run-1")
