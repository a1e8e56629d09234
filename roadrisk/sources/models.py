"""Trained models on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from roadrisk.operators.ml import RiskModel, TrainedModels

CATALOG = "name string, training_order int, features array<string>, labels array<string>, classifiers array<string>, train_rows bigint"


def save_models(spark: SparkSession, trained: TrainedModels, folder: str) -> None:
    """Write every family with its scaler, feature order and classes; an older state is replaced."""
    rows = []
    for order, (name, model) in enumerate(trained.models.items()):
        model.preparation.write().overwrite().save(f"{folder}/{name}/preparation")
        model.regressor.write().overwrite().save(f"{folder}/{name}/regressor")
        for label, classifier in model.classifiers.items():
            classifier.write().overwrite().save(f"{folder}/{name}/classifier-{label}")
        rows.append((name, order, model.features, model.labels, list(model.classifiers), model.train_rows))
    spark.createDataFrame(rows, CATALOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/catalog")


def load_models(spark: SparkSession, folder: str) -> TrainedModels:
    def load(path: str):
        return DefaultParamsReader.loadParamsInstance(path, spark)

    rows = spark.read.parquet(f"{folder}/catalog").orderBy("training_order").collect()  # one per family
    trained = TrainedModels(list(rows[0]["features"]) if rows else [])
    for row in rows:
        base = f"{folder}/{row['name']}"
        trained.models[row["name"]] = RiskModel(
            row["name"],
            list(row["features"]),
            PipelineModel.load(f"{base}/preparation"),
            load(f"{base}/regressor"),
            {label: load(f"{base}/classifier-{label}") for label in row["classifiers"]},
            list(row["labels"]),
            row["train_rows"],
        )
    return trained
