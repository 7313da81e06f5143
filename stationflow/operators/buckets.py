"""Time buckets with copied edges.

A window keyed by station alone puts a busy station's whole history into one task. Keying by
station and time bucket spreads it; the rows near a bucket's edge are copied into the neighbour
that looks at them, so every frame is still complete. The width follows from the reach alone, so
the layout is the same for every table and nothing has to be counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import MINUTE_US, floor_div

BUCKET = "_bucket"
HOME = "_home"

# A bucket is so many times as wide as the reach: a third of the rows are copied.
REACHES = 3


def bucket_width(reach_us: int) -> int:
    return max(MINUTE_US, REACHES * reach_us)


def with_buckets(
    df: DataFrame,
    us: Column,
    *,
    back_us: int = 0,
    ahead_us: int = 0,
    width_us: int | None = None,
) -> DataFrame:
    """Copy each row into every bucket that needs it.

    A row is read by anchors up to ``back_us`` later (they look back) and up to ``ahead_us``
    earlier (they look ahead). ``_home`` marks the one copy that is the row itself.
    """
    width = width_us or bucket_width(back_us + ahead_us)
    first, last = us - F.lit(ahead_us), us + F.lit(back_us)
    spread = df.select(
        "*",
        F.explode(F.sequence(floor_div(first, width), floor_div(last, width))).alias(BUCKET),
    )
    return spread.withColumn(HOME, F.col(BUCKET) == floor_div(us, width))
