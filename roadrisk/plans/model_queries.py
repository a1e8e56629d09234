"""Queries on trained models. Training is kept per session and folder, as several queries share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadrisk.config import POINTS_PER_TASK
from roadrisk.operators import ml, stats, trips
from roadrisk.plans.registry import query
from roadrisk.plans.relations import Inputs
from roadrisk.sources import models as store
from roadrisk.sources.scratch import cut_lineage, new_folder, sized_shuffles

_features: dict[tuple[str, str], DataFrame] = {}
_trained: dict[tuple[str, str, str], ml.TrainedModels] = {}


def features(i: Inputs) -> DataFrame:
    key = (i.spark.sparkContext.applicationId, i.folder)
    if key not in _features:
        points = i.telematics_raw
        with sized_shuffles(i.spark, points.count(), POINTS_PER_TASK):
            _features[key] = cut_lineage(trips.feature_table(trips.features_of_all_drivers(points)))
    return _features[key]


def trained(i: Inputs, *families: str) -> ml.TrainedModels:
    """Models of the named families, all by default, trained once per family.

    A family without a model is an error; one that failed is trained again when it is next asked for.
    """
    wanted = families or ml.FAMILIES
    keys = {family: (i.spark.sparkContext.applicationId, i.folder, family) for family in wanted}
    missing = [family for family in wanted if keys[family] not in _trained]
    found = {family: _trained[keys[family]] for family in wanted if family not in missing}
    if missing:  # together, so that their rows are prepared once
        trained_now = ml.train_models(features(i), families=missing)
        found.update((family, trained_now) for family in missing)
        _trained.update((keys[family], trained_now) for family in missing if family not in trained_now.failures)
    merged = None
    for family in wanted:
        part = found[family]
        merged = merged or ml.TrainedModels(part.features)
        for into, of in zip(merged.parts(), part.parts()):
            into.update({k: v for k, v in of.items() if k == family})
    return merged.whole(wanted)


def scored_by(i: Inputs, family: str) -> DataFrame:
    return trained(i, family).choose(family).transform(features(i))


def compared(i: Inputs) -> DataFrame:
    """Metrics of all families."""
    return ml.metrics_table(trained(i).whole(ml.FAMILIES, "metrics"), i.spark)


@query("ml_random_forest")
def _(i):
    return scored_by(i, "random_forest")


@query("ml_linear_logistic")
def _(i):
    return scored_by(i, "logistic_regression")


@query("ml_gradient_boosting")
def _(i):
    return scored_by(i, "gradient_boosting")


@query("ml_train_all")
def _(i):
    return compared(i)


@query("ml_compare")
def _(i):
    table = compared(i)
    best = stats.best_models(table).select(F.struct("best_regression", "best_classification").alias("b"))
    return table.withColumn("_b", best.scalar()).select("*", "_b.*").drop("_b")


@query("ml_importance")
def _(i):
    return ml.importance_table(trained(i).whole(ml.FAMILIES, "importance"), i.spark)


@query("ml_predict_score")
def _(i):
    return ml.predict_scores(trained(i, "random_forest"), features(i))


@query("ml_predict_category")
def _(i):
    return ml.predict_categories(trained(i, "random_forest"), features(i))


@query("ml_batch_score")
def _(i):
    return ml.batch_score(trained(i, "random_forest"), features(i), "no_such_model")


@query("snk_models")
def _(i):
    """Predictions after writing and reading the models, next to those before."""
    models = trained(i, "random_forest", "logistic_regression")
    folder = new_folder(i.spark, "models")
    store.save_models(i.spark, models, folder)
    again = store.load_models(i.spark, folder)
    after = ml.predict_scores(again, features(i)).withColumnRenamed("risk_score", "reloaded_score")
    return ml.predict_scores(models, features(i)).join(after, "driver_id")


GUESSES = {"close": "y_pred", "damped": "y_pred * 0.8E0", "flat": "0.4E0 + 0 * y_pred"}


def _metric_sql(order: int, model: str, guess: str) -> str:
    return f"""SELECT '{model}' AS model, {order} AS training_order,
  (SELECT 1 - sum(pow(y_true - ({guess}), 2)) / (count(*) * var_pop(y_true)) FROM scored_sample) AS regression_r2,
  (SELECT avg(CASE WHEN p.s > n.s THEN 1.0E0 WHEN p.s = n.s THEN 0.5E0 ELSE 0.0E0 END) FROM (SELECT {guess} AS s FROM scored_sample WHERE y_true > 0.5) p,
    (SELECT {guess} AS s FROM scored_sample WHERE y_true <= 0.5) n) AS classification_auc"""


@query(
    "srt_best_model",
    keep="best_regression best_classification",
    sql="SELECT max_by(model, (regression_r2, -training_order)) AS best_regression, max_by(model, (classification_auc, -training_order)) AS best_classification FROM ("
    + " UNION ALL ".join(_metric_sql(k, m, g) for k, (m, g) in enumerate(GUESSES.items()))
    + ") m",
)
def _(i):
    sample = i.scored_sample.withColumn("label", F.when(F.col("y_true") > 0.5, "high").otherwise("other"))
    table = None
    for order, (model, guess) in enumerate(GUESSES.items()):
        rows = sample.withColumn("guess", F.expr(guess)).withColumn("other", -F.col("guess"))
        auc = stats.macro_auc(rows, "label", {"high": "guess", "other": "other"}).scalar()
        line = stats.regression_metrics(rows, "y_true", "guess").select(
            F.lit(model).alias("model"),
            F.lit(order).alias("training_order"),
            F.col("r2").alias("regression_r2"),
            auc.alias("classification_auc"),
        )
        table = line if table is None else table.unionByName(line)
    return stats.best_models(table)
