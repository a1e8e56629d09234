"""Whole batch jobs: from stored points to models, scores and premiums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadrisk.config import MODEL_RULES, TRIP_RULES, ModelRules, TripRules
from roadrisk.operators import ml, pricing, trips
from roadrisk.sources import files
from roadrisk.sources.models import load_models, save_models
from roadrisk.sources.scratch import cut_lineage


@dataclass
class Training:
    features: DataFrame
    failed: DataFrame
    models: ml.TrainedModels
    comparison: DataFrame


def train(
    spark: SparkSession,
    points: DataFrame,
    folder: str,
    trip_rules: TripRules = TRIP_RULES,
    model_rules: ModelRules = MODEL_RULES,
    targets: DataFrame | None = None,
    target: str = "target",
) -> Training:
    """Points to features, failed drivers, trained models and their comparison.

    Features go to ``folder/features`` as CSV and the models to ``folder/models``. ``targets`` (driver_id and the column
    ``target``, one row per driver) are learned where they are given; drivers without one are left out of the training. Else
    the rule score is the target.
    """
    features = cut_lineage(trips.features_of_all_drivers(points, rules=trip_rules))
    table = trips.feature_table(features)
    if targets is not None:
        known = targets.select("driver_id", F.col(target).cast("double").alias(target)).dropna()
        models = ml.train_models(table.join(known, "driver_id"), target, rules=model_rules)
    else:
        models = ml.train_models(table, rules=model_rules)
    files.write_feature_csv(features, f"{folder}/features", mode="overwrite")
    save_models(spark, models, f"{folder}/models")
    return Training(features, trips.failed_drivers(points, features, trip_rules), models, ml.metrics_table(models, spark))


def price(
    spark: SparkSession,
    points: DataFrame,
    profiles: DataFrame,
    claims: DataFrame,
    zip_context: DataFrame,
    models_folder: str,
    as_of: str,
    model: str = "random_forest",
) -> DataFrame:
    """Premiums of the drivers that have both a profile and usable points, by stored models."""
    features = cut_lineage(trips.features_of_all_drivers(points))
    scores = ml.predict_scores(load_models(spark, models_folder), trips.feature_table(features), model)
    known = profiles.join(features.select("driver_id"), "driver_id", "left_semi")
    rated = features.join(known.select("driver_id"), "driver_id", "left_semi")
    scored = scores.join(known.select("driver_id"), "driver_id", "left_semi")
    return pricing.price_all(known, scored, rated, claims, zip_context, as_of)
