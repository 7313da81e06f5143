"""Row-wise expressions, lookups against a dimension, sorted previews, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import CODES_SQL, HISTORY_SQL, STATIONS_SQL, STATUS_SQL, query, with_views
from stationflow import schemas as S
from stationflow.functions import clock, measures
from stationflow.operators import lookup
from stationflow.operators.newest import current_capacity
from stationflow.operators.rank import dense_codes
from stationflow.plans import conversions
from stationflow.plans import dataset as D
from stationflow.plans.ingest import split_by_propulsion

ST, HI, CA = STATUS_SQL, HISTORY_SQL, STATIONS_SQL


# --- text and numbers --------------------------------------------------------


@query(
    "preferred_text",
    """WITH entries AS (
  SELECT doc_id, source, text, lang,
         CASE doc_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN 'en-CA' WHEN 2 THEN 'fr' ELSE 'de' END
           AS second
  FROM documents)
SELECT doc_id,
       CASE WHEN lower(lang) = 'en' THEN text WHEN lower(second) = 'en' THEN source ELSE text END
         AS preferred
FROM entries""",
)
def _(v):
    second = (
        F.when(F.col("doc_id") % 4 == 0, "EN")
        .when(F.col("doc_id") % 4 == 1, "en-CA")
        .when(F.col("doc_id") % 4 == 2, "fr")
        .otherwise("de")
    )
    entries = F.array(
        F.struct(F.col("text"), F.col("lang").alias("language")),
        F.struct(F.col("source").alias("text"), second.alias("language")),
    )
    return v.table("documents").select(
        "doc_id", measures.preferred_text(entries).alias("preferred")
    )


@query(
    "clip_and_round",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(round_even(least(greatest(0.0::DOUBLE, l_quantity / 2 - 5), cap::DOUBLE), 0)
            AS BIGINT) AS vehicles
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 1000000 ELSE l_partkey % 20 END AS cap
      FROM lineitem)""",
)
def _(v):
    capacity = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 20)
    value = F.col("l_quantity") / 2 - 5
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        measures.whole_vehicles(measures.clip_to_capacity(value, capacity)).alias("vehicles"),
    )


@query(
    "vehicle_split",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 5 = 1 THEN 0 ELSE
    CASE WHEN l_returnflag IN ('A', 'R') THEN CAST(l_quantity AS BIGINT) ELSE 0 END
    END AS num_vehicles_electric,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 5 = 1 THEN 0 ELSE
    CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END
    + CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END
    END AS num_vehicles_human
FROM lineitem""",
)
def _(v):
    """Types A, R are electric, N, F human; O is unknown and counts as neither."""
    entry = "array<struct<vehicle_type_id string, count bigint>>"
    both = F.array(
        F.struct(
            F.col("l_returnflag").alias("vehicle_type_id"),
            F.col("l_quantity").cast("bigint").alias("count"),
        ),
        F.struct(
            F.col("l_linestatus").alias("vehicle_type_id"),
            F.col("l_linenumber").cast("bigint").alias("count"),
        ),
    )
    kind = F.col("l_linenumber") % 5
    entries = F.when(kind == 1, F.array().cast(entry)).when(kind > 1, both.cast(entry))
    electric, human = split_by_propulsion(
        entries,
        F.array(*[F.lit(t) for t in ("A", "R", "N", "F")]),
        F.array(F.lit("A"), F.lit("R")),
    )
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        electric.alias("num_vehicles_electric"),
        human.alias("num_vehicles_human"),
    )


@query(
    "utc_day_and_bounds",
    """SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
       epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_start,
       epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY) AS day_end,
       epoch_us(ts + INTERVAL 120 MINUTE) AS predicted_at,
       strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp
FROM events""",
)
def _(v):
    day = clock.utc_day("ts")
    start = F.timestamp_micros(F.unix_date(day).cast("bigint") * clock.DAY_US)
    return v.table("events").select(
        "event_id",
        day.alias("day"),
        start.alias("day_start"),
        (start + F.make_dt_interval(F.lit(1))).alias("day_end"),
        (F.col("ts").cast("timestamp") + clock.minutes(120)).alias("predicted_at"),
        clock.cycle_stamp("ts").alias("stamp"),
    )


# --- dimension lookups -------------------------------------------------------


@query(
    "station_codes",
    f"""{with_views(HI, CA)}
SELECT system_id, station_id,
       CAST(row_number() OVER (ORDER BY system_id, station_id) - 1 AS INTEGER) AS station_id_code
FROM stations""",
)
def _(v):
    return D.station_codes(v.history)


@query(
    "customer_codes",
    """SELECT c_name, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT c_name FROM customer)""",
)
def _(v):
    return dense_codes(v.table("customer"), ["c_name"], code="code")


@query(
    "encoded_rows",
    f"""{with_views(ST, HI, CODES_SQL)}
SELECT l.system_id, l.station_id, epoch_us(l.observed_at) AS observed_at, c.station_id_code
FROM status l LEFT JOIN codes c USING (system_id, station_id)""",
)
def _(v):
    codes = D.station_codes(v.history.where("station_id <> '7'"))
    return D.encode_stations(v.status.select(*S.IDENTITY), codes)


@query(
    "salted_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
def _(v):
    suppliers = v.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lookup.attach_salted(
        lines, suppliers, ["l_suppkey"], spread_by="l_orderkey", salts=4
    )


@query(
    "unknown_customers",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(v):
    known = v.table("customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey")
    )
    return lookup.unknown_keys(
        v.table("orders").select("o_orderkey", "o_custkey"), known, ["o_custkey"]
    )


def _unknown(v):
    known = v.table("customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey")
    )
    return lookup.unknown_keys(v.table("orders"), known, ["o_custkey"])


@query(
    "unknown_customer_preview",
    """SELECT array_to_string(list(o_custkey ORDER BY o_custkey), ', ') AS preview FROM (
  SELECT o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  ORDER BY o_custkey LIMIT 5)""",
)
def _(v):
    return lookup.preview(_unknown(v), "o_custkey")


@query(
    "unknown_customer_preview_by_priority",
    """SELECT o_orderpriority,
       array_to_string(list(o_custkey ORDER BY o_custkey), ', ') AS preview FROM (
  SELECT DISTINCT o_orderpriority, o_custkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  QUALIFY dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) <= 5)
GROUP BY o_orderpriority""",
)
def _(v):
    return lookup.preview(_unknown(v), "o_custkey", by=["o_orderpriority"], distinct=True)


@query(
    "matched_keys",
    """SELECT count(*) AS matched FROM (
  SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""",
)
def _(v):
    customers = v.table("customer").select(F.col("c_custkey").alias("k"))
    orders = v.table("orders").select(F.col("o_custkey").alias("k"))
    return lookup.common_keys(customers, orders, ["k"]).agg(F.count("*").alias("matched"))


# --- conversions -------------------------------------------------------------


def _lists(v):
    return v.table("lineitem").select(
        "l_orderkey",
        F.array(
            F.struct(
                F.col("l_returnflag").alias("vehicle_type_id"),
                F.col("l_quantity").cast("bigint").alias("count"),
            ),
            F.struct(
                F.col("l_linestatus").alias("vehicle_type_id"),
                F.col("l_linenumber").cast("bigint").alias("count"),
            ),
        ).alias("entries"),
    )


LONG_SQL = """
long AS (
  SELECT l_orderkey, l_returnflag AS vehicle_type_id, CAST(l_quantity AS BIGINT) AS num_vehicles
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linestatus, l_linenumber FROM lineitem)"""


@query("per_type_rows", f"{with_views(LONG_SQL)} SELECT * FROM long")
def _(v):
    return conversions.per_type_rows(_lists(v), "entries", ["l_orderkey"])


@query(
    "propulsion_counts",
    f"""{with_views(LONG_SQL)}
SELECT l_orderkey,
       CAST(sum(CASE WHEN vehicle_type_id IN ('A', 'R') THEN num_vehicles ELSE 0 END) AS BIGINT)
         AS num_vehicles_electric,
       CAST(sum(CASE WHEN vehicle_type_id IN ('N', 'F') THEN num_vehicles ELSE 0 END) AS BIGINT)
         AS num_vehicles_human
FROM long GROUP BY l_orderkey""",
)
def _(v):
    """Types come from the codes in the table; O is left undescribed."""
    flags = v.table("lineitem").select(F.col("l_returnflag").alias("t")).union(
        v.table("lineitem").select("l_linestatus")
    )
    types = flags.distinct().where("t <> 'O'").select(
        F.col("t").alias("vehicle_type_id"),
        F.when(F.col("t").isin("A", "R"), "electric").otherwise("human").alias("propulsion_type"),
    )
    long = conversions.per_type_rows(_lists(v), "entries", ["l_orderkey"])
    return conversions.propulsion_counts(long, types, ["l_orderkey"])


@query(
    "station_attributes",
    f"""{with_views(HI)}
SELECT DISTINCT system_id, station_id, station_name, round(lat, 6) AS lat, round(lon, 6) AS lon,
       capacity
FROM history""",
)
def _(v):
    return conversions.split_station_attributes(v.history)[0]


@query(
    "station_snapshots_without_attributes",
    f"""{with_views(HI)}
SELECT system_id, station_id, address, is_charging_station, epoch_us(observed_at) AS observed_at
FROM history""",
)
def _(v):
    return conversions.split_station_attributes(v.history)[1]


@query(
    "baseline_time",
    f"""{with_views(ST, HI, CA)}
SELECT s.system_id, s.station_id, s.capacity,
       coalesce(max(epoch_us(l.observed_at)),
                (SELECT max(epoch_us(observed_at)) FROM status)) AS observed_at
FROM stations s LEFT JOIN (SELECT * FROM status WHERE station_id <> '3') l
  USING (system_id, station_id) GROUP BY ALL""",
)
def _(v):
    status = v.status
    return conversions.with_baseline_time(
        current_capacity(v.history),
        status.where("station_id <> '3'"),
        status.agg(F.max("observed_at")).scalar(),
    )


@query(
    "superseded_rows_dropped",
    f"""{with_views(HI)}
SELECT system_id, station_id, capacity, epoch_us(observed_at) AS observed_at FROM history h
WHERE NOT EXISTS (SELECT 1 FROM history n WHERE n.system_id = h.system_id
  AND n.station_id = h.station_id AND n.observed_at > h.observed_at)""",
)
def _(v):
    return conversions.drop_superseded(v.history).select(
        "system_id", "station_id", "capacity", "observed_at"
    )
