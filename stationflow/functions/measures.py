"""Small numeric and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def occupancy_ratio(vehicles: str | Column, capacity: str | Column) -> Column:
    """Share of the capacity in use; null without a positive capacity."""
    vehicles, capacity = _col(vehicles), _col(capacity)
    return F.when(capacity > 0, vehicles / capacity)


def clip_to_capacity(value: str | Column, capacity: str | Column) -> Column:
    """Bound a forecast to 0 .. capacity; no upper bound when capacity is null."""
    value = _col(value)
    bounded = F.least(F.greatest(F.lit(0.0), value), _col(capacity).cast("double"))
    return F.when(value.isNotNull(), bounded)


def whole_vehicles(value: str | Column) -> Column:
    """Round half to even."""
    return F.bround(_col(value)).cast("bigint")


def mean_absolute_error(actual: str | Column, predicted: str | Column) -> Column:
    return F.avg(F.abs(_col(actual) - _col(predicted)))


def root_mean_squared_error(actual: str | Column, predicted: str | Column) -> Column:
    gap = (_col(actual) - _col(predicted)).cast("double")
    return F.sqrt(F.avg(gap * gap))


def improvement_pct(baseline: str | Column, model: str | Column) -> Column:
    baseline, model = _col(baseline), _col(model)
    return (baseline - model) / baseline * 100


def preferred_text(entries: str | Column) -> Column:
    """English text if an entry's language is exactly ``en``, else the first entry's."""
    entries = _col(entries)
    english = F.filter(entries, lambda e: F.lower(e["language"]) == "en")
    return F.when(F.size(english) > 0, F.get(english, F.lit(0))["text"]).otherwise(
        F.get(entries, F.lit(0))["text"]
    )
