"""Training the gradient-boosted forecast and keeping its artifacts."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.plans import boosting as B
from stationflow.plans import dataset as D
from stationflow.plans import levelwise as W
from stationflow.plans.boosting import DELTA, PREDICTED_DELTA
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec, labeled_features
from stationflow.session import shared_folder
from stationflow.sources import storage

PREDICTED = "predicted"
ROWS_PER_TASK = 250_000  # of a pass over the rows of a fit, at most
Model = GBTRegressionModel | B.LeafModel


@dataclass(frozen=True)
class TreeSettings:
    """Settings of Spark's depth-wise boosting; depth 6 holds about as many leaves as a 63-leaf tree.

    Boosting stops after ``patience`` rounds without a smaller error on the val rows.
    """

    rounds: int = 500
    step: float = 0.05
    depth: int = 6
    min_rows_per_leaf: int = 50
    seed: int = 42
    patience: int = 30


def _inputs(spec: FeatureSpec) -> list[str]:
    numeric = spec.columns[1:]
    return ["station_id_code", *numeric, *[f"{c}_missing" for c in numeric]]


def assemble(
    df: DataFrame, codes: DataFrame, n_codes: int, spec: FeatureSpec = DEFAULT_SPEC
) -> DataFrame:
    """Add ``features``: the station code as a category, numbers, and a flag per missing number.

    Rows of a station without a code are left out: no code is guessed for them.
    """
    category = {"ml_attr": {"type": "nominal", "num_vals": n_codes, "name": "station_id_code"}}
    keep = tuple(c for c in df.columns if c not in spec.columns[1:])
    current = F.col(D.CURRENT).alias("_current")
    framed = D.model_frame(
        df.select("*", current), codes, spec, keep=(*keep, "_current")
    ).where(F.col("station_id_code").isNotNull())
    columns = [
        F.col("station_id_code").cast("double").alias("station_id_code", metadata=category)
    ]
    for name in spec.columns[1:]:
        columns.append(F.coalesce(name, F.lit(0.0)).alias(name))
        columns.append(F.col(name).isNull().cast("double").alias(f"{name}_missing"))
    kept = [F.col("_current").alias("current_vehicles"), *[F.col(c) for c in keep]]
    assembler = VectorAssembler(inputCols=_inputs(spec), outputCol="features")
    return assembler.transform(framed.select(*kept, *columns)).select(
        "current_vehicles", *keep, "features"
    )


def fit(
    assembled: DataFrame, n_codes: int, settings: TreeSettings = TreeSettings()
) -> GBTRegressionModel:
    """Fit on the train rows; the trees up to the best round on the val rows are kept.

    The booster goes on past the rounds asked for while the val error tells to, and measures each
    round as it goes. One that fits just what it is asked is asked for twice as many rounds, then
    for all; for all at once if the error still falls.
    """
    shared_folder(assembled.sparkSession)
    rounds = min(settings.rounds, 2 * settings.patience)
    while True:
        model = _boosted(n_codes, settings, rounds).fit(assembled)
        errors = _val_errors(model, assembled)
        best, done = best_round(errors, settings.patience), max(rounds, len(errors))
        if best + settings.patience <= done or done >= settings.rounds:
            return first_trees(model, best)
        falls = best > rounds - settings.patience // 3
        again = rounds > 2 * settings.patience
        rounds = settings.rounds if falls or again else min(settings.rounds, 2 * rounds)


def _val_errors(model: GBTRegressionModel, assembled: DataFrame) -> list[float]:
    """Squared error of the first k trees on the val rows, for every k."""
    if getattr(model, "measured_on", None) is assembled:
        return [rmse**2 for split, _, _, rmse in model.history if split == "val"]
    return model.evaluateEachIteration(assembled.where(F.col("split") == "val"), "squared")


def best_round(errors: list[float], patience: int) -> int:
    """The first round that no round within ``patience`` after it improves on; counted from 1.

    Errors that are not numbers (no val rows) stop nothing: all rounds are kept.
    """
    best = 0
    for place, error in enumerate(errors):
        if not error < errors[best] and place:
            if place - best >= patience:
                break
        else:
            best = place
    return len(errors) if errors and errors[best] != errors[best] else best + 1


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The same model with its first ``n`` trees."""
    if n >= model.getNumTrees:
        return model
    own, spark = model._java_obj, SparkSession.getActiveSession()
    gateway = spark.sparkContext._gateway
    regression = spark._jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = own.trees()[i], own.treeWeights()[i]
    short = regression.GBTRegressionModel(own.uid(), trees, weights, own.numFeatures())
    kept = GBTRegressionModel(short)
    kept._resetUid(own.uid())
    for name in ("featuresCol", "labelCol", "predictionCol"):
        short.set(short.getParam(name), own.getOrDefault(own.getParam(name)))
    kept._transfer_params_from_java()
    if hasattr(model, "grown"):
        kept.grown, kept.n_codes = model.grown[:n], model.n_codes
        kept.measured_on = model.measured_on
        kept.history = [row for row in model.history if row[1] <= n]
    return kept


def _boosted(n_codes: int, settings: TreeSettings, rounds: int) -> W.Boosting:
    spark_booster = GBTRegressor(
        labelCol=DELTA,
        featuresCol="features",
        predictionCol=PREDICTED_DELTA,
        maxIter=rounds,
        stepSize=settings.step,
        maxDepth=settings.depth,
        minInstancesPerNode=settings.min_rows_per_leaf,
        seed=settings.seed,
        maxBins=max(32, n_codes),
    )
    return W.Boosting(spark_booster, n_codes, rounds, settings.patience, settings.rounds)


def model_rows(
    kind: Model | TreeSettings | B.LeafSettings,
    df: DataFrame,
    codes: DataFrame,
    n_codes: int,
    spec: FeatureSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Rows in the form that a model of this kind, or one with these settings, reads."""
    if isinstance(kind, B.LeafModel | B.LeafSettings):
        return B.training_frame(df, codes, spec)
    return assemble(df, codes, n_codes, spec)


def training_rows(
    settings: TreeSettings | B.LeafSettings,
    df: DataFrame,
    codes: DataFrame,
    n_codes: int,
    spec: FeatureSpec = DEFAULT_SPEC,
) -> DataFrame:
    """``model_rows`` dealt evenly over all cores, for the hundreds of passes of a fit.

    The join with the codes leaves a station's rows together, and its small partitions are merged:
    a fit would run on the few cores that hold stations.
    """
    rows = model_rows(settings, df, codes, n_codes, spec)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))


def predict(model: Model, assembled: DataFrame) -> DataFrame:
    """Add the predicted change and the forecast, current value plus change."""
    if isinstance(model, B.LeafModel):
        scored = B.predict(model, assembled)
    elif hasattr(model, "grown"):
        scored = W.predict(model, assembled)
    else:
        scored = model.transform(assembled)
    return scored.withColumn(PREDICTED, F.col("current_vehicles") + F.col(PREDICTED_DELTA))


def round_history(model: Model, assembled: DataFrame) -> DataFrame:
    """Error of the first k trees, for every k, on the train and val rows.

    A leaf-wise model brings its own, with the rounds after the best one; a depth-wise one the
    errors of the frame it was fitted on.
    """
    if isinstance(model, B.LeafModel):
        return B.round_history(model, assembled)
    ddl = "split string, round int, mae double, rmse double"
    if getattr(model, "measured_on", None) is assembled:
        return assembled.sparkSession.createDataFrame(sorted(model.history), ddl)
    rows = []
    for split in ("train", "val"):
        part = assembled.where(F.col("split") == split)
        absolute = model.evaluateEachIteration(part, "absolute")
        squared = model.evaluateEachIteration(part, "squared")
        rows += [
            (split, k, float(a), float(s) ** 0.5)
            for k, (a, s) in enumerate(zip(absolute, squared), start=1)
        ]
    return assembled.sparkSession.createDataFrame(rows, ddl)


# --- artifacts ---------------------------------------------------------------


TREES = "trees.json"


def save_artifacts(
    path: str, model: Model, codes: DataFrame, metadata: dict
) -> None:
    """Store model, codes and metadata; a leaf-wise model is a text file."""
    spark = codes.sparkSession
    if isinstance(model, B.LeafModel):
        storage.delete(spark, f"{path}/model")
        storage.write_text(spark, f"{path}/model/{TREES}", model.to_json())
    else:
        model.write().overwrite().save(f"{path}/model")
    codes.write.mode("overwrite").parquet(f"{path}/station_codes")
    storage.write_text(spark, f"{path}/metadata.json", json.dumps(metadata, sort_keys=True))


def save_record(path: str, **tables: DataFrame) -> None:
    """What a run was and how it went, one small table each, beside its artifacts."""
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/record/{name}")


def artifacts_exist(spark: SparkSession, path: str) -> bool:
    """A model is usable only with its codes and its metadata."""
    parts = ("model", "station_codes", "metadata.json")
    return all(storage.exists(spark, f"{path}/{part}") for part in parts)


def load_artifacts(spark: SparkSession, path: str) -> tuple[Model, DataFrame, dict]:
    trees = storage.read_text(spark, f"{path}/model/{TREES}")
    return (
        GBTRegressionModel.load(f"{path}/model") if trees is None else B.LeafModel.from_json(trees),
        spark.read.schema("system_id string, station_id string, station_id_code int").parquet(
            f"{path}/station_codes"
        ),
        json.loads(storage.read_text(spark, f"{path}/metadata.json")),
    )


# --- the job -----------------------------------------------------------------


@dataclass(frozen=True)
class TrainingRun:
    model: Model
    codes: DataFrame
    parameters: DataFrame
    baseline: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    metadata: dict


def prepare_training_table(
    raw: DataFrame,
    catalog: DataFrame,
    path: str,
    spec: FeatureSpec = DEFAULT_SPEC,
    *,
    horizon_minutes: int = S.HORIZON_MINUTES,
    tolerance_minutes: int = S.LABEL_TOLERANCE_MINUTES,
    min_rows: int = S.MIN_STATION_ROWS,
) -> DataFrame:
    """Labelled, filtered and split rows, written once and read back.

    The filter, the cutoffs and the fit all read the labelled rows, so these are a table,
    not a plan that would run again for each.
    """
    spark = raw.sparkSession
    labeled = labeled_features(
        raw,
        catalog,
        spec,
        horizon_minutes=horizon_minutes,
        tolerance_minutes=tolerance_minutes,
    )
    labeled.write.mode("overwrite").parquet(f"{path}/labeled")
    stored = spark.read.schema(labeled.schema).parquet(f"{path}/labeled")
    return D.with_delta(D.apply_quality_filters(stored, min_rows))


def train(
    raw: DataFrame,
    catalog: DataFrame,
    work_path: str,
    model_path: str,
    *,
    run_id: str,
    spec: FeatureSpec = DEFAULT_SPEC,
    settings: B.LeafSettings | TreeSettings = B.LeafSettings(),
    horizon_minutes: int = S.HORIZON_MINUTES,
    tolerance_minutes: int = S.LABEL_TOLERANCE_MINUTES,
    min_rows: int = S.MIN_STATION_ROWS,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
) -> TrainingRun:
    """The whole training run: table, split, baseline, model, metrics, artifacts.

    The settings choose the booster: leaf by leaf, or Spark's depth-wise one.
    """
    filtered = prepare_training_table(
        raw,
        catalog,
        work_path,
        spec,
        horizon_minutes=horizon_minutes,
        tolerance_minutes=tolerance_minutes,
        min_rows=min_rows,
    )
    cutoffs = D.split_cutoffs(filtered)
    split = D.time_split(filtered, cutoffs)
    codes = D.station_codes(catalog).persist()
    n_codes = codes.count()
    assembled = training_rows(settings, split, codes, n_codes, spec).persist()
    if isinstance(settings, B.LeafSettings):
        model = B.fit(assembled, settings, spec)
    else:
        model = fit(assembled, n_codes, settings)
    metrics = D.split_metrics(predict(model, assembled), PREDICTED)
    baseline = D.split_metrics(split)
    comparison = D.compare_to_baseline(baseline, metrics)
    parameters = D.run_parameters(
        split,
        cutoffs,
        horizon_minutes=horizon_minutes,
        tolerance_minutes=tolerance_minutes,
        min_rows=min_rows,
    )
    # one row per split
    test = {row["split"]: row for row in metrics.collect()}.get("test")
    gain = {row["split"]: row for row in comparison.collect()}.get("test")
    sizes = parameters.first()
    metadata = {
        "run_id": run_id,
        "trained_at": now().isoformat(),
        "horizon_minutes": horizon_minutes,
        "n_train_rows": sizes["n_train_rows"],
        "n_stations": sizes["n_stations"],
        "test_mae": test and test["mae"],
        "test_rmse": test and test["rmse"],
        "test_mae_improvement_over_baseline_pct": gain and gain["improvement_pct"],
        "feature_columns": spec.columns,
    }
    save_artifacts(model_path, model, codes, metadata)
    save_record(
        model_path,
        round_history=round_history(model, assembled),
        baseline=baseline,
        metrics=metrics,
        parameters=parameters,
    )
    assembled.unpersist()
    return TrainingRun(model, codes, parameters, baseline, metrics, comparison, metadata)


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    """The run's metadata as one row."""
    return spark.createDataFrame(
        [tuple(metadata.values())],
        "run_id string, trained_at string, horizon_minutes int, n_train_rows bigint, "
        "n_stations bigint, test_mae double, test_rmse double, "
        "test_mae_improvement_over_baseline_pct double, feature_columns array<string>",
    )
