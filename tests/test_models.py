"""Training, scoring, metrics and storage of the models on small tables."""

from __future__ import annotations

import tempfile
import threading
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from roadrisk.config import MODEL_RULES
from roadrisk.operators import ml, stats
from roadrisk.plans import model_queries
from roadrisk.plans.catalog import QUERIES
from roadrisk.sources import models as store
from roadrisk.sources.scratch import SHUFFLE_SETTING, sized_shuffles

RULES = replace(MODEL_RULES, trees=10, rounds=5, forest_depth=5, boosting_depth=3)


@pytest.fixture(scope="module")
def features(spark):
    return spark.range(400).select(
        F.concat(F.lit("d"), "id").alias("driver_id"),
        (F.abs(F.hash("id", F.lit(1))) % 40).alias("harsh_braking_count"),
        (F.abs(F.hash("id", F.lit(2))) % 40).alias("harsh_acceleration_count"),
        (F.abs(F.hash("id", F.lit(3))) % 100 / 250.0).alias("over_speed_ratio"),
        F.when(F.col("id") % 9 > 0, F.abs(F.hash("id", F.lit(4))) % 100 / 400.0).alias("phone_usage_ratio"),
        F.lit("text").alias("comment"),
    )


@pytest.fixture(scope="module")
def trained(features):
    # a target with all three classes, as the rule score alone is never low
    known = features.withColumn(
        "known_score", F.col("harsh_braking_count") / 80.0 + F.col("over_speed_ratio") + F.col("harsh_acceleration_count") / 400.0
    )
    return ml.train_models(known, "known_score", rules=RULES)


def test_all_families_learn(trained, spark):
    assert list(trained.models) == list(ml.FAMILIES) and not trained.failures
    assert "comment" not in trained.features and "known_score" not in trained.features
    table = {r["model"]: r for r in ml.metrics_table(trained, spark).collect()}
    for row in table.values():
        assert row["regression_r2"] > 0.5 and row["classification_auc"] > 0.8
    assert table["logistic_regression"]["regression_r2"] > 0.99
    assert stats.best_models(ml.metrics_table(trained, spark)).first()["best_regression"] == "logistic_regression"


def test_scores_and_chances(trained, features):
    for name in ml.FAMILIES:
        rows = trained.choose(name).transform(features.drop("comment")).collect()
        assert len(rows) == 400
        for row in rows:
            chances = {label: row[f"p_{label}"] for label in ml.CLASSES}
            assert 0 <= row["risk_score"] <= 1 and sum(chances.values()) == pytest.approx(1)
            assert chances[row["category"]] == max(chances.values())


def test_missing_and_extra_columns(trained, features):
    bare = features.select("driver_id", "harsh_braking_count", F.lit(1.0).alias("surplus"))
    assert ml.predict_scores(trained, bare).count() == 400
    assert ml.predict_scores(trained, bare, "no_such_model").collect() == ml.predict_scores(trained, bare).collect()


def test_several_rows_of_a_driver_are_scored_once_each(trained, features):
    twice = features.withColumn("bucket", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = trained.choose("random_forest").transform(twice)
    assert rows.count() == 800 and rows.select("driver_id", "bucket").distinct().count() == 800


def test_training_repeats(features):
    one = ml.train_models(features, families=("random_forest",), rules=RULES)
    two = ml.train_models(features.repartition(3), families=("random_forest",), rules=RULES)
    assert one.features == two.features
    first = {r[0]: r[1] for r in one.choose("random_forest").transform(features).select("driver_id", "risk_score").collect()}
    assert 0.4 < sum(first.values()) / 400 < 1


def test_importance(trained):
    for name in ml.FAMILIES:
        assert set(trained.importance[name]) == set(trained.features)
    assert ml.regressor_importance(trained.choose("logistic_regression")) == {}
    forest = ml.regressor_importance(trained.choose("random_forest"))
    assert max(forest, key=forest.get) in ("harsh_braking_count", "over_speed_ratio")
    assert sum(forest.values()) == pytest.approx(1)


def test_save_and_load(trained, features, spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    store.save_models(spark, trained, folder)
    again = store.load_models(spark, folder)
    assert list(again.models) == list(trained.models) and again.features == trained.features
    for name in ml.FAMILIES:
        before = sorted(trained.choose(name).transform(features.drop("comment")).collect())
        assert sorted(again.choose(name).transform(features.drop("comment")).collect()) == before


def test_too_few_rows(features):
    result = ml.train_models(features.limit(4), rules=RULES)
    assert not result.models
    with pytest.raises(ValueError):
        result.choose("random_forest")


def test_a_failing_family_is_skipped(features):
    result = ml.train_models(features, families=("no_such_family", "logistic_regression"), rules=RULES)
    assert list(result.models) == ["logistic_regression"] and "no_such_family" in result.failures


def test_noise_is_normal_and_stable(spark):
    df = spark.range(20000).select(F.concat(F.lit("d"), "id").alias("driver_id"))
    noisy = df.withColumn("e", ml.driver_noise(0.1, 42))
    row = noisy.agg(F.avg("e").alias("m"), F.stddev("e").alias("s"), F.max("e").alias("x")).first()
    assert abs(row["m"]) < 0.003 and abs(row["s"] - 0.1) < 0.003 and 0.3 < row["x"] < 0.6
    assert noisy.exceptAll(df.repartition(3).withColumn("e", ml.driver_noise(0.1, 42))).isEmpty()


def test_target_from_present_columns_only(spark):
    df = spark.createDataFrame([("d", 100, 1.0)], "driver_id string, harsh_braking_count int, night_driving_ratio double")
    assert ml.with_synthetic_target(df, noise_sd=0.0).first()["risk_score"] == pytest.approx(0.8)


def test_shuffles_grow_with_the_rows_and_go_back(spark):
    before = spark.conf.get(SHUFFLE_SETTING)
    with sized_shuffles(spark, 70_000_001, 1_000_000):
        assert spark.conf.get(SHUFFLE_SETTING) == "71"
    with sized_shuffles(spark, 10, 1_000_000):
        assert spark.conf.get(SHUFFLE_SETTING) == before
    with pytest.raises(ValueError), sized_shuffles(spark, 70_000_001, 1_000_000):
        raise ValueError
    assert spark.conf.get(SHUFFLE_SETTING) == before


def test_features_are_shuffled_in_parts_of_bounded_size(spark, inputs, monkeypatch):
    before, seen = spark.conf.get(SHUFFLE_SETTING), []
    monkeypatch.setattr(model_queries, "_features", {})
    monkeypatch.setattr(model_queries, "POINTS_PER_TASK", 1000)
    monkeypatch.setattr(model_queries, "cut_lineage", lambda df: seen.append(spark.conf.get(SHUFFLE_SETTING)) or df)
    model_queries.features(inputs)
    points = inputs.telematics_raw.count()
    assert points > 4000 and seen == [str(-(-points // 1000))] and spark.conf.get(SHUFFLE_SETTING) == before


def test_families_train_side_by_side(features, monkeypatch):
    together = threading.Barrier(2, timeout=60)

    def fit(name, *rest):
        together.wait()
        raise ValueError(name)

    monkeypatch.setattr(ml, "fit_family", fit)
    result = ml.train_models(features, families=("one", "two"), rules=RULES)
    assert list(result.failures.items()) == [("one", "one"), ("two", "two")] and not result.models
    assert ml.train_models(features, families=(), rules=RULES).failures == {}


def test_rows_are_prepared_once_for_all_missing_families(inputs, monkeypatch):
    asked = []

    def train(features, families):
        asked.append(list(families))
        return ml.TrainedModels(["f"], {n: n for n in families}, {n: {"m": 1.0} for n in families}, {n: {"f": 1.0} for n in families})

    monkeypatch.setattr(model_queries, "_trained", {})
    monkeypatch.setattr(model_queries, "features", lambda i: None)
    monkeypatch.setattr(ml, "train_models", train)
    assert list(model_queries.trained(inputs, "random_forest").models) == ["random_forest"]
    merged = model_queries.trained(inputs)
    assert [list(part) for part in merged.parts()] == [list(ml.FAMILIES)] * 3 + [[]]
    assert asked == [["random_forest"], ["logistic_regression", "gradient_boosting"]]


@pytest.fixture
def fresh(features, monkeypatch):
    """The model queries on the small table with nothing trained yet; a function that lets one step fail for boosting."""
    monkeypatch.setattr(model_queries, "_trained", {})
    monkeypatch.setattr(model_queries, "features", lambda i: features)
    monkeypatch.setattr(ml, "train_models", partial(ml.train_models, rules=RULES))

    def fail(step, family_of):
        whole = getattr(ml, step)

        def failing(first, *rest):
            if family_of(first) == "gradient_boosting":
                raise OSError("no space left")
            return whole(first, *rest)

        monkeypatch.setattr(ml, step, failing)
        return lambda: monkeypatch.setattr(ml, step, whole)

    return fail


def models_of(query, spark):
    return {row["model"] for row in QUERIES[query].run(spark, "small").collect()}


def test_a_failed_family_is_no_shorter_comparison(spark, fresh):
    mend = fresh("fit_family", str)
    for query in ("ml_compare", "ml_train_all"):
        with pytest.raises(ValueError, match="gradient_boosting: no space left"):
            models_of(query, spark)
    mend()
    for query in ("ml_compare", "ml_train_all"):  # the failure is not kept
        assert models_of(query, spark) == set(ml.FAMILIES)


def test_a_failed_evaluation_is_no_shorter_comparison(spark, fresh):
    fresh("evaluate", lambda model: model.name)
    with pytest.raises(ValueError, match="gradient_boosting: no space left"):
        models_of("ml_compare", spark)
    assert QUERIES["ml_gradient_boosting"].run(spark, "small").count() == 400  # the model itself is whole


def test_too_few_rows_are_no_empty_comparison(spark, fresh, features, monkeypatch):
    few = features.limit(4)
    assert ml.train_models(few).failures == dict.fromkeys(ml.FAMILIES, "fewer than 5 rows")
    monkeypatch.setattr(model_queries, "features", lambda i: few)
    with pytest.raises(ValueError, match="fewer than 5 rows"):
        models_of("ml_compare", spark)


@pytest.mark.parametrize("step, family_of", [("fit_family", str), ("importance_of", lambda model: model.name)])
def test_a_failed_family_is_no_shorter_importance(spark, fresh, step, family_of):
    mend = fresh(step, family_of)
    with pytest.raises(ValueError, match="gradient_boosting: no space left"):
        models_of("ml_importance", spark)
    mend()
    assert models_of("ml_importance", spark) == set(ml.FAMILIES)


def test_importance_needs_rows_but_no_evaluation(spark, fresh, features, monkeypatch):
    fresh("evaluate", lambda model: model.name)
    assert models_of("ml_importance", spark) == set(ml.FAMILIES)
    monkeypatch.setattr(model_queries, "_trained", {})
    monkeypatch.setattr(model_queries, "features", lambda i: features.limit(4))
    with pytest.raises(ValueError, match="fewer than 5 rows"):
        models_of("ml_importance", spark)
