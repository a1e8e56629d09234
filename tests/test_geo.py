"""Lengths on the ellipsoid against published values and the sphere."""

from __future__ import annotations

import math

import pytest

from roadrisk.functions.geo import METRES_PER_MILE, TRIP_EARTH_RADIUS, with_ellipsoid_miles


def angle(degrees, minutes, seconds):
    return math.copysign(abs(degrees) + minutes / 60 + seconds / 3600, degrees)


KNOWN = [  # metres
    (0.0, 0.0, 0.0, 1.0, 111_319.4908),  # along the equator
    (0.0, 0.0, 90.0, 0.0, 10_001_965.7293),  # a quarter of a meridian
    (angle(-37, 57, 3.72030), angle(144, 25, 29.52440), angle(-37, 39, 10.15610), angle(143, 55, 35.38390), 54_972.271),
    (10.0, 20.0, 10.0, 20.0, 0.0),
    (-90.0, 0.0, 90.0, 0.0, 20_003_931.4586),
]


def test_known_lengths(spark):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(KNOWN)], "k int, a double, b double, c double, d double, metres double")
    for row in with_ellipsoid_miles(df, "a", "b", "c", "d", "miles").collect():
        assert row["miles"] * METRES_PER_MILE == pytest.approx(row["metres"], rel=1e-9, abs=1e-3)
        assert row["miles_settled"]


def test_opposite_points_are_flagged_and_measured_on_the_sphere(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.5, 179.7), (0.0, 0.0, None, 1.0)], "a double, b double, c double, d double")
    far, unknown = with_ellipsoid_miles(df, "a", "b", "c", "d", "miles").collect()
    assert not far["miles_settled"] and far["miles"] == pytest.approx(math.pi * TRIP_EARTH_RADIUS, rel=0.01)
    assert unknown["miles"] is None
