"""The audited archive: days published, corrected, refused, and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parity.registry import STATUS_SQL, query, with_views
from stationflow import schemas as S
from stationflow.functions.clock import utc_day
from stationflow.session import scratch_folder
from stationflow.sources import archive

CORRECTED, REFUSED = dt.date(2024, 1, 10), dt.date(2024, 1, 11)


def published(v) -> str:
    """An archive of all days; one is corrected, the correction of another fails its audit."""
    path = f"{scratch_folder(v.spark)}/{S.STATION_STATUS}"
    archive.publish_days(v.status, path, S.STATION_STATUS)
    more = v.status.withColumn("num_vehicles_available", F.col("num_vehicles_available") + 1000)
    more = more.where(F.col("is_renting"))
    day = utc_day("observed_at")
    archive.publish_days(more.where(day == F.lit(CORRECTED)), path, S.STATION_STATUS)

    def too_many(rows):
        return ["too many vehicles"] if rows.where("num_vehicles_available >= 1000").count() else []

    try:
        archive.publish_days(more.where(day == F.lit(REFUSED)), path, S.STATION_STATUS, [too_many])
    except archive.AuditError:
        return path
    raise RuntimeError("the audit did not refuse the day")


STORED = """stored AS (
  SELECT observed_at, CAST(observed_at AS DATE) AS day, is_renting,
         num_vehicles_available + CASE WHEN CAST(observed_at AS DATE) = DATE '2024-01-10'
                                       THEN 1000 ELSE 0 END AS vehicles
  FROM status WHERE CAST(observed_at AS DATE) <> DATE '2024-01-10' OR is_renting)"""


@query(
    "published_days",
    f"""{with_views(STATUS_SQL, STORED)}
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, epoch_us(min(observed_at)) AS oldest,
       epoch_us(max(observed_at)) AS newest FROM stored GROUP BY day""",
)
def _(v):
    return archive.manifest_rows(v.spark, published(v)).drop("version")


@query(
    "published_rows",
    f"""{with_views(STATUS_SQL, STORED)}
SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS rows, CAST(sum(vehicles) AS BIGINT) AS vehicles
FROM stored GROUP BY day""",
)
def _(v):
    rows = archive.read(v.spark, published(v), S.STATION_STATUS)
    return rows.groupBy("date").agg(
        F.count("*").alias("rows"), F.sum("num_vehicles_available").alias("vehicles")
    )
