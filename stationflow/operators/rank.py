"""Positions in a global order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions.clock import DAY_US, SECOND_US, floor_div, micros
from stationflow.session import settle_in_order


def positional_cutoffs(
    df: DataFrame, fractions: Sequence[float], *, time: str = "observed_at"
) -> DataFrame:
    """``(cut, us)``: the instant at position ``floor(n * fraction)`` of the time order.

    Narrows from days to seconds to microseconds. Each running sum covers one row per day,
    then at most 86,400 seconds of one day, then at most 1,000,000 instants of one second,
    so its size is bounded whatever the number of rows.
    """
    counts = df.groupBy(micros(time).alias("_us")).agg(F.count("*").alias("_n"))

    days = counts.groupBy(floor_div(F.col("_us"), DAY_US).alias("_day")).agg(
        F.sum("_n").alias("_n")
    )
    running = days.select(
        "_day",
        "_n",
        F.sum("_n").over(Window.orderBy("_day")).alias("_upto"),
    )
    total = days.agg(F.sum("_n")).scalar()
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("cut"), F.floor(total * F.lit(f)).alias("k"))
            for i, f in enumerate(fractions)
        ]
    )
    before = F.col("_upto") - F.col("_n")
    found = (
        running.select("*", F.inline(wanted))
        .where((F.col("k") >= before) & (F.col("k") < F.col("_upto")))
        .select("cut", (F.col("k") - before).alias("k"), F.col("_day").alias("_parent"))
    )
    for parent, unit in ((DAY_US, SECOND_US), (SECOND_US, 1)):
        found = _narrow(counts, found, parent, unit)
    return found.select("cut", F.col("_parent").alias("us"))


def _narrow(counts: DataFrame, found: DataFrame, parent_us: int, unit_us: int) -> DataFrame:
    """Descend one level: from a parent interval to the unit inside it."""
    units = (
        counts.select("*", floor_div(F.col("_us"), parent_us).alias("_parent"))
        # one row per requested fraction
        .join(F.broadcast(found), "_parent")
        .groupBy("cut", "k", floor_div(F.col("_us"), unit_us).alias("_unit"))
        .agg(F.sum("_n").alias("_n"))
    )
    upto = F.sum("_n").over(Window.partitionBy("cut").orderBy("_unit"))
    before = F.col("_upto") - F.col("_n")
    return (
        units.withColumn("_upto", upto)
        .where((F.col("k") >= before) & (F.col("k") < F.col("_upto")))
        .select("cut", (F.col("k") - before).alias("k"), F.col("_unit").alias("_parent"))
    )


def dense_codes(
    df: DataFrame, columns: Sequence[str], *, code: str = "station_id_code"
) -> DataFrame:
    """Enumerate the distinct values of ``columns`` from 0 in sorted order.

    The distinct values are range-sorted across tasks and checkpointed, so that numbering
    rows inside partitions and adding each partition's offset sees one fixed layout. Only
    one row per partition passes through the running sum.
    """
    ordered = settle_in_order(df.select(*columns).dropna().distinct().orderBy(*columns))
    position = F.monotonically_increasing_id()
    placed = ordered.select(
        *columns,
        F.shiftright(position, 33).alias("_part"),
        position.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    starts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(starts), F.lit(0)).alias("_start"))
    )
    # one row per partition of the sorted values
    return placed.join(F.broadcast(offsets), "_part").select(
        *columns, (F.col("_start") + F.col("_row")).cast("int").alias(code)
    )
