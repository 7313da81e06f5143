"""From labelled rows to a time-ordered training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.clock import micros
from stationflow.functions.measures import (
    improvement_pct,
    mean_absolute_error,
    root_mean_squared_error,
)
from stationflow.operators.lookup import attach
from stationflow.operators.rank import dense_codes, positional_cutoffs
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec

SPLITS = ("train", "val", "test")
ACTUAL = "target_num_vehicles_available"
CURRENT = "num_vehicles_available"


def in_service(df: DataFrame) -> DataFrame:
    """Rows of stations installed and renting at that moment; unknown counts as not."""
    return df.where(F.col("is_installed") & F.col("is_renting"))


def station_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*S.STATION_KEY).agg(F.count("*").alias("n"))


def apply_quality_filters(labeled: DataFrame, min_rows: int = S.MIN_STATION_ROWS) -> DataFrame:
    """In-service rows of stations that keep at least ``min_rows`` of them."""
    served = in_service(labeled)
    kept = station_rows(served).where(F.col("n") >= min_rows)
    return served.join(kept, list(S.STATION_KEY), "left_semi")


def split_cutoffs(
    df: DataFrame,
    train_fraction: float = S.TRAIN_FRACTION,
    val_fraction: float = S.VALIDATION_FRACTION,
) -> DataFrame:
    """One row ``(train_cutoff, val_cutoff)``: times at two positions of the pooled order.

    Nulls for no rows.
    """
    cuts = positional_cutoffs(df, [train_fraction, train_fraction + val_fraction])

    def time_of(cut: int):
        return F.timestamp_micros(F.max(F.when(F.col("cut") == cut, F.col("us"))))

    return cuts.agg(time_of(0).alias("train_cutoff"), time_of(1).alias("val_cutoff"))


def time_split(df: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """Add ``split``: train before the first cutoff, val before the second, test after.

    Cutoffs read ``df`` once more, so hand in a written table rather than a long plan.
    """
    cutoffs = split_cutoffs(df) if cutoffs is None else cutoffs
    cut = cutoffs.select(F.struct("train_cutoff", "val_cutoff")).scalar()
    time = F.col("observed_at")
    split = (
        F.when(time < cut["train_cutoff"], "train")
        .when(time < cut["val_cutoff"], "val")
        .when(time >= cut["val_cutoff"], "test")
    )
    return df.withColumn("split", split)


def station_codes(catalog: DataFrame) -> DataFrame:
    """Integer code per station of the full catalog, in sorted order from 0."""
    return dense_codes(catalog, S.STATION_KEY)


def encode_stations(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``station_id_code``; null for a station the codes do not hold."""
    return attach(df, codes, S.STATION_KEY)


def model_columns(spec: FeatureSpec = DEFAULT_SPEC) -> list[str]:
    return ["station_id_code", *spec.columns[1:]]


def model_frame(
    df: DataFrame, codes: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Station code plus every numeric feature as double, in model order."""
    numeric = [F.col(c).cast("double").alias(c) for c in spec.columns[1:]]
    return encode_stations(df, codes).select(
        *keep, F.col("station_id_code").cast("int").alias("station_id_code"), *numeric
    )


def with_delta(df: DataFrame) -> DataFrame:
    """Training target: the change from the current value."""
    return df.withColumn("target_delta", F.col(ACTUAL) - F.col(CURRENT))


def split_metrics(df: DataFrame, predicted: str = CURRENT) -> DataFrame:
    """Error per split; by default of the persistence forecast (nothing changes)."""
    return df.groupBy("split").agg(
        mean_absolute_error(ACTUAL, predicted).alias("mae"),
        root_mean_squared_error(ACTUAL, predicted).alias("rmse"),
        F.count("*").alias("n_rows"),
    )


def compare_to_baseline(baseline: DataFrame, model: DataFrame) -> DataFrame:
    """Per split: both errors and the improvement of the mean absolute error."""
    return (
        baseline.select("split", F.col("mae").alias("baseline_mae"))
        .join(model.select("split", F.col("mae").alias("model_mae")), "split")
        .withColumn("improvement_pct", improvement_pct("baseline_mae", "model_mae"))
    )


def run_parameters(
    split: DataFrame,
    cutoffs: DataFrame,
    *,
    horizon_minutes: int = S.HORIZON_MINUTES,
    tolerance_minutes: int = S.LABEL_TOLERANCE_MINUTES,
    min_rows: int = S.MIN_STATION_ROWS,
) -> DataFrame:
    """One row: settings, split bounds, rows per split, stations trained on."""
    cut = cutoffs.select(F.struct("train_cutoff", "val_cutoff")).scalar()
    stations = (
        split.where(F.col("split") == "train").select(*S.STATION_KEY).distinct()
    )
    trained = stations.agg(F.count("*")).scalar()
    sizes = [F.count_if(F.col("split") == s).alias(f"n_{s}_rows") for s in SPLITS]
    bounds = split.agg(
        F.min("observed_at").alias("train_start"),
        F.max("observed_at").alias("test_end"),
        *sizes,
    )
    return bounds.select(
        F.lit(horizon_minutes).alias("horizon_minutes"),
        F.lit(tolerance_minutes).alias("target_tolerance_minutes"),
        F.lit(min_rows).alias("min_station_history_rows"),
        "train_start",
        cut["train_cutoff"].alias("train_end"),
        cut["train_cutoff"].alias("val_start"),
        cut["val_cutoff"].alias("val_end"),
        cut["val_cutoff"].alias("test_start"),
        "test_end",
        *[f"n_{s}_rows" for s in SPLITS],
        trained.alias("n_stations"),
    )


def busiest_test_station(split: DataFrame) -> DataFrame:
    """One row: the station with most test rows, the first id among equals."""
    tested = station_rows(split.where(F.col("split") == "test"))
    return tested.orderBy(F.desc("n"), *S.STATION_KEY).limit(1)


def station_series(split: DataFrame, station: DataFrame) -> DataFrame:
    """Test series of the given stations: observed time, actual, persistence."""
    return (
        split.where(F.col("split") == "test")
        .join(station.select(*S.STATION_KEY), list(S.STATION_KEY), "left_semi")
        .select(
            *S.STATION_KEY,
            "observed_at",
            F.col(ACTUAL).alias("actual"),
            F.col(CURRENT).alias("persistence"),
        )
        .orderBy("observed_at", *S.STATION_KEY)
    )
