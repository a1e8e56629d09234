"""Medians, scaling and metrics against NumPy and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from roadrisk.operators import stats


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 100, 101, 5000])
def test_medians_are_exact(spark, size):
    rng = random.Random(size)
    rows = [
        (float(rng.randint(0, 9)), rng.gauss(0, 1e6), None if rng.random() < 0.3 and n else 2.5, float("nan") if n % 2 and n > 2 else float(n))
        for n in range(size)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = stats.exact_medians(df, ["a", "b", "c", "d"]).first()
    for k, name in enumerate("abcd"):
        column = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        assert got[name] == np.median(column)


@pytest.mark.parametrize("kind", ["cluster", "infinite", "tiny", "constant"])
def test_medians_of_uneven_columns(spark, kind):
    """Values that crowd in a small part of the bracket, and bounds that are infinite or next to each other."""
    rng = random.Random(kind)
    make = {
        "cluster": lambda k: 1e12 if k % 3 == 0 else (-1e12 if k % 3 == 1 else rng.random() * 1e-9),
        "infinite": lambda k: math.inf if k % 2 else -math.inf,
        "tiny": lambda k: 5e-324 * rng.randint(0, 4),
        "constant": lambda k: -0.25,
    }[kind]
    rows = [(make(k), rng.gauss(0, 1)) for k in range(4001 if kind != "infinite" else 4003)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    got = stats.exact_medians(df, ["a", "b"]).first()
    assert got["a"] == sorted(r[0] for r in rows)[len(rows) // 2]
    assert got["b"] == np.median([r[1] for r in rows])


def test_medians_take_two_scans_and_order_no_whole_column(spark):
    df = spark.range(1000).selectExpr("CAST(id % 97 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b")
    medians = stats.exact_medians(df, ["a", "b"])
    assert tuple(medians.first()) == (np.median([k % 97 for k in range(1000)]), 499.5)
    plan = medians._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("[name" in line and "rank" in line for line in windows)


def test_imputing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    assert sorted(tuple(r) for r in stats.impute_medians(df, ["a", "b"]).collect()) == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (6.0, 7.0)], "a double, b double")
    rows = sorted(tuple(r) for r in stats.standardize(df, ["a", "b"]).collect())
    a = np.array([1.0, 2.0, 6.0])
    assert [r[0] for r in rows] == pytest.approx(((a - a.mean()) / a.std()).tolist())
    assert [r[1] for r in rows] == [0.0, 0.0, 0.0]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = stats.regression_metrics(df, "y", "p").first()
    y, p = np.array([1, 2, 4.0]), np.array([1.5, 2, 3.0])
    assert row["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def brute_auc(rows, k, label):
    pos = [r[k] for r in rows if r[0] == label]
    neg = [r[k] for r in rows if r[0] != label]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("steps", [3, 10_000])
def test_auc_with_ties(spark, steps):
    rng = random.Random(steps)
    rows = [(rng.choice("xyz"), *[rng.randint(0, steps) / steps for _ in range(3)]) for _ in range(700)]
    df = spark.createDataFrame(rows, "label string, x double, y double, z double")
    got = stats.macro_auc(df, "label", {c: c for c in "xyz"}).first()[0]
    assert got == pytest.approx(np.mean([brute_auc(rows, k + 1, c) for k, c in enumerate("xyz")]))


def test_auc_needs_every_class(spark):
    df = spark.createDataFrame([("x", 0.1, 0.9), ("x", 0.2, 0.8)], "label string, x double, y double")
    assert stats.macro_auc(df, "label", {"x": "x", "y": "y"}).first()[0] is None


def test_best_model_prefers_the_first_on_ties(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.5, None), ("b", 1, 0.5, 0.8), ("c", 2, 0.4, 0.8)],
        "model string, training_order int, regression_r2 double, classification_auc double",
    )
    assert tuple(stats.best_models(df).first()) == ("a", "b")
