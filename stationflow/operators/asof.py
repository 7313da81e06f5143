"""As-of lookups with a tolerance.

Every lookup is a running frame (unbounded start), which Spark evaluates by adding each
row once. Looking ahead is the same frame over descending time: a frame with an unbounded
end, or a sliding one, would be re-evaluated for each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions.clock import MINUTE_US, micros
from stationflow.operators.buckets import BUCKET, HOME, with_buckets


def nearest_columns(
    order: WindowSpec, us: Column, value: Column, reach_us: int, name: str
) -> list[Column]:
    """Time and value of the nearest reading at least ``reach_us`` away, unchecked.

    ``order`` sorts one station's rows by time (to look back) or by negated time (to look
    ahead).
    """
    frame = order.rangeBetween(Window.unboundedPreceding, -reach_us)
    return [
        F.last(us).over(frame).alias(f"_{name}_us"),
        F.last(value).over(frame).alias(f"_{name}_value"),
    ]


def within(us: Column, limit_us: int, name: str) -> tuple[Column, Column]:
    """The columns above as (time, value), null where further than ``limit_us`` away."""
    found_us, value = F.col(f"_{name}_us"), F.col(f"_{name}_value")
    close = F.abs(found_us - us) <= F.lit(limit_us)
    return F.when(close, found_us), F.when(close, value)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: dict[str, str],
    strategy: str = "backward",
    offset_minutes: int = 0,
    tolerance_minutes: int,
    matched_time: str | None = None,
    bucket_us: int | None = None,
) -> DataFrame:
    """Left join each row to the nearest right row in one direction of time.

    The search time is ``left_time`` plus ``offset_minutes``; ``backward`` takes the last
    right row at or before it, ``forward`` the first at or after it, both at most
    ``tolerance_minutes`` away (inclusive). ``values`` maps right columns to output names,
    ``matched_time`` names the matched time in the output. Right rows must be unique in
    (by, time), and times must not be null.

    Both sides are united and scanned once in time order, so the work is linear in the
    rows, whatever the number of candidates inside the tolerance.
    """
    if strategy not in ("backward", "forward"):
        raise ValueError(f"unknown as-of strategy: {strategy}")
    tolerance_us = tolerance_minutes * MINUTE_US
    backward = strategy == "backward"

    right_us = micros(right_time)
    readings = right.where(
        F.col(right_time).isNotNull()
    ).select(
        *by,
        right_us.alias("_at"),
        F.struct(right_us.alias("us"), F.col(right_time).alias("t"),
                 *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]).alias("_right"),
    )
    search_us = micros(left_time) + F.lit(offset_minutes * MINUTE_US)
    anchors = left.select(*by, search_us.alias("_at"), F.struct(*left.columns).alias("_left"))

    at = F.col("_at")
    reach = {
        "width_us": bucket_us,
        "back_us": tolerance_us if backward else 0,
        "ahead_us": 0 if backward else tolerance_us,
    }
    readings = with_buckets(readings, at, **reach).drop(HOME)
    # an anchor reads others and is read by none, so only its own copy is of use
    anchors = with_buckets(anchors, at, **reach)
    anchors = anchors.where(HOME).drop(HOME)

    order = F.col("_at") if backward else -F.col("_at")
    frame = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.last("_right", ignorenulls=True).over(frame)
    joined = (
        anchors.unionByName(readings, allowMissingColumns=True)
        .select("_at", "_left", found.alias("_found"))
        .where(F.col("_left").isNotNull())
    )
    gap = F.abs(F.col("_at") - F.col("_found.us"))
    hit = gap <= F.lit(tolerance_us)
    out = [F.when(hit, F.col(f"_found.v{i}")).alias(n) for i, n in enumerate(values.values())]
    if matched_time is not None:
        out.insert(0, F.when(hit, F.col("_found.t")).alias(matched_time))
    return joined.select("_left.*", *out)
