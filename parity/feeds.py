"""Feed parsing, validation and flattening on payloads built from ``events``.

Every event becomes one landed cycle of five JSON payloads describing two stations. Some
cycles break a rule, chosen by the event id; the SQL works on the events themselves, so it
checks parsing, validation and flattening end to end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.registry import Views, query
from stationflow import schemas as S
from stationflow.operators.changes import collapse_changes
from stationflow.plans import ingest as I
from stationflow.sources import feeds as G


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def payloads(v: Views):
    """Landed payload rows, five per event (four where a feed is missing)."""
    e, ts = F.col("event_id"), F.col("ts")
    station = F.col("user_id") % 20
    vehicles = F.floor("value").cast("bigint")
    iso = _text(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), "Z")
    seconds = F.unix_seconds(ts.cast("timestamp"))

    def envelope(updated, data, version="3.0"):
        version = F.lit(version) if isinstance(version, str) else version
        return _text(
            '{"last_updated":', updated, ',"ttl":60,"version":"', version,
            '","extra":{"ignored":[1]},"data":', data, "}",
        )

    quoted = _text('"', iso, '"')
    names = ("gbfs", "system_information", "vehicle_types", "station_information", "station_status")
    listed = ",".join(f'{{"name":"{n}","url":"https://feeds.example.org/{n}.json"}}' for n in names)
    discovery = envelope(quoted, F.lit(f'{{"feeds":[{listed}]}}'))
    system = envelope(
        quoted, _text('{"system_id":"', F.when(station < 10, "sys-a").otherwise("sys-b"), '"}')
    )
    types = envelope(
        quoted,
        F.lit(
            '{"vehicle_types":[{"vehicle_type_id":"CLASSIC","form_factor":"bicycle",'
            '"propulsion_type":"human","name":[{"text":"Classic","language":"en"}]},'
            '{"vehicle_type_id":"EBIKE","form_factor":"bicycle",'
            '"propulsion_type":"electric_assist"}]}'
        ),
    )
    name = (
        F.when(e % 23 == 9, _text('"Station ', station, '"'))
        .otherwise(
            _text('[{"text":"Gare ', station, '","language":"fr"},',
                  '{"text":"Station ', station, '","language":"EN"}]')
        )
    )
    latitude = F.when(e % 31 == 6, F.lit("95.5")).otherwise(
        _text("43.", F.lpad(station.cast("string"), 2, "0"))
    )
    information = envelope(
        quoted,
        _text(
            '{"stations":[{"station_id":"st-', station, '","name":', name, ',"lat":', latitude,
            ',"lon":-79.5,"address":"', station, ' Main St","capacity":', vehicles + 10,
            ',"rental_methods":["key","phone"],"is_charging_station":true},',
            '{"station_id":"tw-', station, '","name":[{"text":"Deux ', station,
            '","language":"fr"}],"lat":"44.5","lon":-80}]}',
        ),
        F.when(e % 11 == 3, "2.3").otherwise("3.0"),
    )
    count = F.when(e % 13 == 5, F.lit("-1")).when(
        F.col("event_type") == "click", _text('"', vehicles, '"')
    ).otherwise(vehicles.cast("string"))
    cargo = F.when(e % 19 == 4, ',{"vehicle_type_id":"CARGO","count":1}').otherwise("")
    per_type = (
        F.when(F.col("event_type") == "view", F.lit(""))
        .when(F.col("event_type") == "signup", F.lit(',"vehicle_types_available":[]'))
        .otherwise(
            _text(',"vehicle_types_available":[{"vehicle_type_id":"CLASSIC","count":', e % 5,
                  '},{"vehicle_type_id":"EBIKE","count":', e % 3, "}", cargo, "]")
        )
    )
    disabled = F.when(e % 4 != 0, _text(',"num_vehicles_disabled":', e % 4)).otherwise("")
    second = F.when(e % 17 == 7, F.lit("ghost-")).otherwise("tw-")
    status = F.when(e % 37 == 8, F.lit('["not an object"]')).otherwise(
        envelope(
            seconds,
            _text(
                '{"stations":[{"station_id":"st-', station, '","num_vehicles_available":', count,
                per_type, disabled, ',"num_docks_available":', F.greatest(F.lit(0), 50 - vehicles),
                ',"is_installed":', F.col("event_type") != "error",
                ',"is_renting":true,"is_returning":true,"last_reported":"',
                F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00"},',
                '{"station_id":"', second, station, '","num_vehicles_available":1,',
                '"is_installed":true,"is_renting":false,"is_returning":true,"last_reported":',
                seconds, "}]}",
            ),
        )
    )
    # One select per feed, so that reading one feed does not build the others. A payload is
    # a hundred times its event, so the events are spread first.
    events = v.table("events").repartition(v.spark.sparkContext.defaultParallelism)
    bodies = dict(zip(names, (discovery, system, types, information, status)))

    def rows(feed):
        kept = events.where(e % 29 != 2) if feed == "vehicle_types" else events
        return kept.select(
            e.cast("string").alias("cycle_id"),
            ts.cast("timestamp").alias("observed_at"),
            F.lit(feed).alias("feed"),
            bodies[feed].alias("payload"),
        )

    return reduce(DataFrame.unionByName, [rows(feed) for feed in names])


EVENTS = """ev AS (
  SELECT event_id AS e, CAST(event_id AS VARCHAR) AS cycle_id, ts, event_type,
         user_id % 20 AS u, CAST(floor(value) AS BIGINT) AS v,
         CASE WHEN user_id % 20 < 10 THEN 'sys-a' ELSE 'sys-b' END AS system_id,
         event_type NOT IN ('view', 'signup') AS typed
  FROM events)"""

SCHEMA_BAD = """(e % 11 = 3 OR e % 13 = 5 AND e % 37 <> 8 OR e % 23 = 9 OR e % 29 = 2
   OR e % 31 = 6 OR e % 37 = 8)"""
CLEAN = f"NOT {SCHEMA_BAD} AND e % 17 <> 7 AND NOT (e % 19 = 4 AND typed)"

RULES_SQL = """
  SELECT cycle_id, 'station_information' AS feed, NULL::INTEGER AS pos, 'version' AS path,
         'enum' AS rule, '2.3' AS value FROM ev WHERE e % 11 = 3
  UNION ALL SELECT cycle_id, 'station_status', 0, 'num_vehicles_available', 'count', '-1'
  FROM ev WHERE e % 13 = 5 AND e % 37 <> 8
  UNION ALL SELECT cycle_id, 'station_information', 0, 'name', 'localized', 'Station ' || u
  FROM ev WHERE e % 23 = 9
  UNION ALL SELECT cycle_id, 'station_information', 0, 'lat', 'range', '95.5'
  FROM ev WHERE e % 31 = 6
  UNION ALL SELECT cycle_id, 'station_status', NULL, '', 'object', NULL
  FROM ev WHERE e % 37 = 8"""
MISSING_SQL = """
  UNION ALL SELECT cycle_id, 'vehicle_types', NULL, '', 'missing_feed', NULL
  FROM ev WHERE e % 29 = 2"""
ACROSS_SQL = f"""
  UNION ALL SELECT cycle_id, 'station_status', 1, 'station_id', 'unknown_station', 'ghost-' || u
  FROM ev WHERE e % 17 = 7 AND NOT {SCHEMA_BAD}
  UNION ALL SELECT cycle_id, 'station_status', 0, 'vehicle_types_available.vehicle_type_id',
         'unknown_vehicle_type', 'CARGO'
  FROM ev WHERE e % 19 = 4 AND typed AND NOT {SCHEMA_BAD}"""


@query("feed_violations", f"WITH {EVENTS} {RULES_SQL} {MISSING_SQL}")
def _(v):
    return I.validate(payloads(v))


@query("cycle_violations", f"WITH {EVENTS} {RULES_SQL} {MISSING_SQL} {ACROSS_SQL}")
def _(v):
    return I.cycle_violations(payloads(v))


@query(
    "violation_preview",
    f"""WITH {EVENTS}, found AS ({RULES_SQL} {MISSING_SQL} {ACROSS_SQL})
SELECT cycle_id, rule, array_to_string(list(value ORDER BY value)[1:5], ', ') AS preview
FROM (SELECT cycle_id, rule, value FROM found
      WHERE value IS NOT NULL AND rule <> 'unknown_vehicle_type'
      UNION ALL
      SELECT DISTINCT cycle_id, rule, value FROM found
      WHERE value IS NOT NULL AND rule = 'unknown_vehicle_type') GROUP BY ALL""",
)
def _(v):
    return I.violation_preview(I.cycle_violations(payloads(v)))


@query(
    "feed_verdicts",
    f"""WITH {EVENTS}, found AS ({RULES_SQL})
SELECT cycle_id, feed, NOT EXISTS (
  SELECT 1 FROM found f WHERE f.cycle_id = ev.cycle_id AND f.feed = n.feed) AS valid
FROM ev, (SELECT unnest(['gbfs', 'system_information', 'vehicle_types', 'station_information',
                         'station_status']) AS feed) n
WHERE NOT (feed = 'vehicle_types' AND e % 29 = 2)""",
)
def _(v):
    return G.feed_verdicts(payloads(v))


@query(
    "replayed_cycle_last_wins",
    f"""WITH {EVENTS}, found AS ({RULES_SQL})
SELECT cycle_id, feed, e % 2 = 0 AND NOT EXISTS (
  SELECT 1 FROM found f WHERE f.cycle_id = ev.cycle_id AND f.feed = n.feed) AS valid
FROM ev, (SELECT unnest(['gbfs', 'system_information', 'vehicle_types', 'station_information',
                         'station_status']) AS feed) n
WHERE NOT (feed = 'vehicle_types' AND e % 29 = 2)""",
)
def _(v):
    """Every cycle lands twice, once broken: first in even cycles, last in odd ones."""
    rows, odd = payloads(v), F.col("cycle_id").cast("bigint") % 2
    landed = rows.withColumn("arrived", F.lit(2)).unionByName(
        rows.withColumn("payload", F.lit("[]")).withColumn("arrived", 1 + 2 * odd.cast("int"))
    )
    return G.feed_verdicts(G.last_arrivals(landed))


@query(
    "text_type_violations",
    f"""WITH {EVENTS}
SELECT cycle_id, 'station_information' AS feed, 0 AS pos, 'station_id' AS path, 'text' AS rule,
       CAST(u AS VARCHAR) AS value FROM ev WHERE e % 5 = 1
UNION ALL SELECT cycle_id, 'station_information', 0, 'address', 'text', '{{"n":' || u || '}}'
FROM ev WHERE e % 5 = 2
UNION ALL SELECT cycle_id, 'station_information', 0, 'rental_uris', 'uris', '{{"web":' || u || '}}'
FROM ev WHERE e % 5 = 3
UNION ALL SELECT cycle_id, 'station_information', 0, 'rental_methods', 'enum',
       '["cash","phone"]' FROM ev WHERE e % 5 = 4
UNION ALL SELECT cycle_id, 'station_information', 0, 'lat', 'required', NULL
FROM ev WHERE e % 5 = 0""",
)
def _(v):
    """Numbers and objects where texts belong, a bad link, a bad method, a missing field."""
    rows = payloads(v).where(F.col("feed") == G.STATION_INFORMATION)
    kind = F.col("cycle_id").cast("bigint") % 5

    def changed(pattern, by):
        return F.regexp_replace("payload", pattern, by)

    payload = (
        F.when(kind == 1, changed('"station_id":"st-([0-9]+)"', '"station_id":$1'))
        .when(kind == 2, changed('"address":"([0-9]+) Main St"', '"address":{"n":$1}'))
        .when(kind == 3, changed('("station_id":"st-)([0-9]+)(")', '"rental_uris":{"web":$2},$1$2$3'))
        .when(kind == 4, changed('"key","phone"', '"cash","phone"'))
        .otherwise(changed(',"lat":[0-9.]+', ""))
    )
    found = G.feed_violations(rows.withColumn("payload", payload), G.STATION_INFORMATION)
    paths = ("station_id", "address", "rental_uris", "rental_methods", "lat")
    return found.where(F.col("path").isin(*paths) & (F.col("rule") != "range"))


@query(
    "complete_cycles",
    f"""WITH {EVENTS}
SELECT cycle_id, 5 - n AS valid_feeds, n = 0 AS complete FROM (
  SELECT cycle_id, CAST(e % 11 = 3 OR e % 23 = 9 OR e % 31 = 6 AS BIGINT)
    + CAST(e % 13 = 5 OR e % 37 = 8 AS BIGINT) + CAST(e % 29 = 2 AS BIGINT) AS n FROM ev)""",
)
def _(v):
    return G.complete_cycles(payloads(v))


@query(
    "feed_urls",
    f"""WITH {EVENTS}
SELECT cycle_id, feed, 'https://feeds.example.org/' || feed || '.json' AS url
FROM ev, (SELECT unnest(['system_information', 'vehicle_types', 'station_information',
                         'station_status']) AS feed)""",
)
def _(v):
    return G.resolve_feed_urls(payloads(v))


STATION_ROWS = f"""
  SELECT system_id, 'st-' || u AS station_id, 'Station ' || u AS station_name,
         u || ' Main St' AS address, round(43 + u / 100, 6) AS lat, -79.5::DOUBLE AS lon,
         v + 10 AS capacity, TRUE AS is_charging_station, epoch_us(ts) AS observed_at
  FROM ev WHERE {CLEAN}
  UNION ALL
  SELECT system_id, 'tw-' || u, 'Deux ' || u, NULL, 44.5, -80, NULL, NULL, epoch_us(ts)
  FROM ev WHERE {CLEAN}"""


@query("flattened_stations", f"WITH {EVENTS} {STATION_ROWS}")
def _(v):
    return I.flatten_cycles(payloads(v)).stations


STATUS_ROWS = f"""
  SELECT system_id, 'st-' || u AS station_id, epoch_us(ts) AS observed_at,
         v AS num_vehicles_available,
         CASE WHEN e % 4 <> 0 THEN e % 4 END AS num_vehicles_disabled,
         greatest(0, 50 - v) AS num_docks_available, NULL::BIGINT AS num_docks_disabled,
         event_type <> 'error' AS is_installed, TRUE AS is_renting, TRUE AS is_returning,
         CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 0 ELSE e % 3 END
           AS num_vehicles_electric,
         CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 0 ELSE e % 5 END
           AS num_vehicles_human
  FROM ev WHERE {CLEAN}
  UNION ALL
  SELECT system_id, 'tw-' || u, epoch_us(ts), 1, NULL, NULL, NULL, TRUE, FALSE, TRUE, NULL, NULL
  FROM ev WHERE {CLEAN}"""


@query("flattened_status", f"WITH {EVENTS} {STATUS_ROWS}")
def _(v):
    return I.flatten_cycles(payloads(v)).status


@query(
    "flattened_vehicle_types",
    f"""WITH {EVENTS}
SELECT cycle_id, 'CLASSIC' AS vehicle_type_id, 'bicycle' AS form_factor,
       'human' AS propulsion_type, 'Classic' AS name FROM ev WHERE e % 29 <> 2
UNION ALL
SELECT cycle_id, 'EBIKE', 'bicycle', 'electric_assist', NULL FROM ev WHERE e % 29 <> 2""",
)
def _(v):
    return I.vehicle_types(payloads(v))


@query(
    "archived_station_changes",
    f"""WITH {EVENTS}, rows AS ({STATION_ROWS}), marked AS (
  SELECT *, (station_name, address, lat, lon, capacity, is_charging_station)
            IS DISTINCT FROM
            lag((station_name, address, lat, lon, capacity, is_charging_station)) OVER w AS changed
  FROM rows WINDOW w AS (PARTITION BY system_id, station_id, observed_at // 86400000000
                         ORDER BY observed_at))
SELECT * EXCLUDE (changed) FROM marked WHERE changed""",
)
def _(v):
    return collapse_changes(I.flatten_cycles(payloads(v)).stations)


@query(
    "flattened_domain_violations",
    f"""WITH {EVENTS}
SELECT system_id, 'st-' || u AS station_id, epoch_us(ts) AS observed_at,
       'num_vehicles_available' AS path
FROM ev WHERE e % 13 = 5 AND e % 37 <> 8 AND e % 29 <> 2""",
)
def _(v):
    return I.domain_violations(I.status_rows(payloads(v)), S.STATION_STATUS)


@query(
    "ingestion_summary",
    f"""WITH {EVENTS}
SELECT cycle_id, system_id,
       epoch_us(date_trunc('second', ts)) AS station_information_last_updated,
       CASE WHEN e % 37 <> 8 THEN epoch_us(date_trunc('second', ts)) END
         AS station_status_last_updated,
       2::BIGINT AS station_count,
       CAST(CASE WHEN e % 37 = 8 THEN 0 ELSE 2 END AS BIGINT) AS status_count,
       CAST(CASE WHEN e % 37 = 8 THEN 0 ELSE 2 END AS BIGINT) AS processed_station_status_count,
       CAST(CASE WHEN e % 37 = 8 THEN 0 WHEN e % 17 = 7 THEN 1 ELSE 2 END AS BIGINT)
         AS matched_station_status_count
FROM ev""",
)
def _(v):
    return I.ingestion_summary(payloads(v))


@query(
    "json_objects",
    """SELECT event_id, event_id % 3 <> 1 AND event_id % 5 <> 2 AS is_object FROM events""",
)
def _(v):
    payload = (
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("event_id") % 5 == 2, F.concat("props", F.lit(",")))
        .otherwise(F.concat(F.lit("  "), "props"))
    )
    rows = v.table("events").select("event_id", payload.alias("payload"))
    return rows.select("event_id", G.is_json_object().alias("is_object"))


