"""Change detection along a station's history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions.clock import DAY_US, MINUTE_US, floor_div, micros
from stationflow.operators.buckets import BUCKET
from stationflow.schemas import STATION_KEY, TRACKED_STATION_FIELDS


# A state is carried from bucket to bucket; a day has 144 of them.
CARRY_US = 10 * MINUTE_US


def with_previous(
    df: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = STATION_KEY,
    time: str = "observed_at",
    reset_us: int = DAY_US,
    bucket_us: int = CARRY_US,
) -> DataFrame:
    """Add ``_now`` and ``_previous`` (structs) of ``columns`` per key and reset period.

    ``_previous`` is null on the first row of a period. Rows are ordered inside short
    buckets; the last state of a bucket is carried to the next non-empty one, so no task has
    to hold a whole period of one key, and the input is not counted first.
    """
    if reset_us % bucket_us:
        raise ValueError("the bucket must divide the reset period")
    us = F.col("_us")
    keyed = df.select(
        "*",
        micros(time).alias("_us"),
        F.struct(*columns).alias("_now"),
    ).withColumn(BUCKET, floor_div(us, bucket_us))
    part = [*keys, BUCKET]

    tails = keyed.groupBy(*part).agg(F.max_by("_now", "_us").alias("_tail"))
    periods = Window.partitionBy(
        *keys, floor_div(F.col(BUCKET), reset_us // bucket_us)
    ).orderBy(BUCKET)
    carried = tails.select(*part, F.lag("_tail").over(periods).alias("_carried")).where(
        F.col("_carried").isNotNull()
    )

    inside = keyed.withColumn(
        "_inside", F.lag("_now").over(Window.partitionBy(*part).orderBy("_us"))
    )
    return (
        inside.join(carried, part, "left")
        .withColumn("_previous", F.coalesce("_inside", "_carried"))
        .drop("_us", BUCKET, "_inside", "_carried")
    )


def changed_rows(
    df: DataFrame, columns: Sequence[str] = TRACKED_STATION_FIELDS, **options
) -> DataFrame:
    """Rows whose ``columns`` differ (null-safe) from the previous row of the period."""
    marked = with_previous(df, columns, **options)
    return marked.where(~F.col("_now").eqNullSafe(F.col("_previous"))).select(*df.columns)


def first_of_day(df: DataFrame) -> DataFrame:
    """Rows at each station's first instant of a UTC day."""
    day = floor_div(micros("observed_at"), DAY_US)
    firsts = df.groupBy(*STATION_KEY, day.alias("_day")).agg(
        F.min("observed_at").alias("observed_at")
    )
    return df.join(firsts, [*STATION_KEY, "observed_at"], "left_semi")


def collapse_changes(
    df: DataFrame, columns: Sequence[str] = TRACKED_STATION_FIELDS, **options
) -> DataFrame:
    """Reduce full snapshots to distinct states, with a baseline per station and day.

    The first row of a day has no previous row, so it always counts as changed. Collapsing
    twice gives the same rows.
    """
    return changed_rows(df, columns, **options)
