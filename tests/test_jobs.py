"""The batch jobs from stored points to premiums, and file round trips."""

from __future__ import annotations

import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from roadrisk import jobs, schemas
from roadrisk.config import MODEL_RULES
from roadrisk.operators import pricing
from roadrisk.sources import files

RULES = replace(MODEL_RULES, trees=5, rounds=3, forest_depth=4, boosting_depth=2)


def test_train_then_price(spark, inputs):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    files.write_points_csv(inputs.telematics_raw, f"{folder}/points")
    points = files.read_points_csv(spark, f"{folder}/points")
    result = jobs.train(spark, points, f"{folder}/out", model_rules=RULES)
    drivers = result.features.count()
    assert drivers == 15 and result.failed.isEmpty() and result.models.models
    assert files.read_feature_csv(spark, f"{folder}/out/features").count() == drivers
    priced = jobs.price(
        spark, points, inputs.drivers, inputs.claims, inputs.zip_context, f"{folder}/out/models", "2025-02-01"
    )
    rows = priced.collect()
    assert len(rows) == drivers and all(300 <= r["final_premium"] <= 5000 for r in rows)
    files.write_premium_csv(priced, f"{folder}/premiums")
    assert files.read_premium_csv(spark, f"{folder}/premiums").count() == drivers
    assert pricing.market_position(priced).first()["total_drivers"] == drivers


def test_train_on_given_targets(spark, inputs, monkeypatch):
    """The given column is learned and is no feature; drivers without one stay out of the training."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    points = inputs.telematics_raw
    drivers = points.select("driver_id").distinct()
    claims = drivers.select("driver_id", F.when(F.col("driver_id") != "driver_00001", F.lit(0.625)).alias("claim_rate"))
    every = jobs.ml.train_models
    monkeypatch.setattr(jobs.ml, "train_models", lambda *a, **b: every(*a, families=("random_forest",), **b))
    result = jobs.train(spark, points, f"{folder}/out", model_rules=RULES, targets=claims, target="claim_rate")
    assert "claim_rate" not in result.models.features
    scores = jobs.ml.predict_scores(result.models, result.features).collect()
    assert len(scores) == drivers.count() and {round(r["risk_score"], 9) for r in scores} == {0.625}
    assert result.models.choose("random_forest").train_rows < drivers.count()


def test_plain_points_and_wrong_headers(spark, inputs):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    points = inputs.telematics_raw
    files.write_points_csv(points.drop("seq"), f"{folder}/plain")
    back = files.read_points_csv(spark, f"{folder}/plain", numbered=False)
    assert back.schema == schemas.PLAIN_POINTS
    sums = lambda df: df.agg(F.sum("speed_mph"), F.count("*"), F.min("timestamp"), F.max("timestamp")).first()
    assert tuple(sums(back)) == tuple(sums(points))
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_points_csv(spark, f"{folder}/plain").collect()


def test_uploads_from_json(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = spark.createDataFrame(
        [(1, "d", '[{"trip_id":"t","speed_mph":3.5,"harsh_braking":1}]'), (2, None, "[]")],
        "upload_id bigint, driver_id string, trip_data string",
    )
    rows.write.json(f"{folder}/uploads")
    from roadrisk.operators import feeds

    back = files.read_uploads_json(spark, f"{folder}/uploads")
    good = feeds.upload_rows(feeds.accepted(back, ("driver_id", "trip_data"))).collect()
    assert [tuple(r) for r in good] == [(1, "d", "t", 3.5, 1)]
