"""Trailing time-range statistics as differences of running totals.

The total over (t - m, t] is the running total at t minus the running total at t - m. Both
are running frames, so the cost does not depend on how many rows fall inside m. Inputs are
whole counts, for which the totals are exact in doubles.

Windowed columns come first (``running_totals``), each named once, and the statistics are
plain arithmetic on them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stationflow.functions.clock import MINUTE_US


def running_totals(
    order: WindowSpec, value: Column, *, means: Iterable[int], stds: Iterable[int]
) -> list[Column]:
    """Count, sum and sum of squares up to each row and up to ``m`` minutes before it."""
    means, stds = set(means), set(stds)
    number = value.cast("double")
    count, total, squares = F.count(value), F.sum(number), F.sum(number * number)
    columns = []
    for minutes in (0, *sorted(means | stds)):
        frame = order.rangeBetween(Window.unboundedPreceding, -minutes * MINUTE_US)
        columns.append(count.over(frame).alias(f"_n{minutes}"))
        columns.append(total.over(frame).alias(f"_s{minutes}"))
        if stds and (minutes == 0 or minutes in stds):
            columns.append(squares.over(frame).alias(f"_q{minutes}"))
    return columns


def _inside(kind: str, minutes: int) -> Column:
    return F.col(f"_{kind}0") - F.coalesce(F.col(f"_{kind}{minutes}"), F.lit(0))


def trailing_mean(minutes: int) -> Column:
    """Mean of the non-null values in (t - minutes, t]."""
    count = _inside("n", minutes)
    return F.when(count > 0, _inside("s", minutes) / count)


def trailing_std(minutes: int) -> Column:
    """Sample standard deviation over the same range; null below two values."""
    count = _inside("n", minutes).cast("double")
    total, squares = _inside("s", minutes), _inside("q", minutes)
    spread = F.greatest(count * squares - total * total, F.lit(0.0))
    return F.when(count > 1, F.sqrt(spread / (count * (count - 1))))
