"""Dimension lookups and reference checks.

No side is broadcast by hint: a dimension may outgrow any fixed bound, so the choice is
left to the measured size, with skew-split sort-merge joins beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attach(fact: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left lookup by equal keys."""
    return fact.join(dimension, list(on), "left")


def attach_salted(
    fact: DataFrame, dimension: DataFrame, on: Sequence[str], *, spread_by: str, salts: int
) -> DataFrame:
    """Left lookup that splits every key over ``salts`` tasks.

    For a dimension too large to broadcast joined to facts with a very hot key. The
    dimension is copied ``salts`` times, the facts once.
    """
    spread = F.pmod(F.xxhash64(spread_by), F.lit(salts))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        fact.withColumn("_salt", spread.cast("int"))
        .join(copies, [*on, "_salt"], "left")
        .drop("_salt")
    )


def unknown_keys(fact: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Fact rows whose key the dimension does not hold."""
    return fact.join(dimension.select(*on).distinct(), list(on), "left_anti")


def common_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return left.select(*on).intersect(right.select(*on))


def preview(
    df: DataFrame, column: str, *, by: Sequence[str] = (), size: int = 5, distinct: bool = False
) -> DataFrame:
    """First ``size`` sorted values per group, as an array.

    Ranks with a limit, which each task applies before the shuffle, and only then collects
    the few survivors.
    """
    values = df.select(*by, column)
    if distinct:
        values = values.distinct()
    if not by:
        values = values.orderBy(column).limit(size)
    else:
        order = Window.partitionBy(*by).orderBy(column)
        values = values.select("*", F.row_number().over(order).alias("_n")).where(
            F.col("_n") <= size
        )
    return values.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias("preview"))
