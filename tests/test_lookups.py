"""Lookups with a time to live against a plain walk through each place."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from roadrisk.operators import lookups

START = datetime(2024, 1, 1)
KIND = "id long, place string, at timestamp_ntz, answered_by string"


def walked(rows, hours):
    want, current = {}, {}
    for key, place, at, _ in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        known = current.get(place)
        if known is None or at >= known[1] + timedelta(hours=hours):
            known = current[place] = (key, at)
        want[key] = known
    return {r[0]: want.get(r[0], (r[0], r[2])) for r in rows}


@pytest.mark.parametrize("hours", [1, 24])
def test_answers_equal_a_walk(spark, hours):
    """One busy place with a chain of many links, ties, exact ends of a day, and lookups without place or time."""
    rng = random.Random(hours)
    rows = []
    for k in range(700):
        place = rng.choice(["busy", "busy", "b", "c", None])
        at = START + timedelta(hours=rng.choice([0, 24, 48, rng.randrange(900)]), seconds=rng.choice([0, 0, 1, -1]), microseconds=rng.choice([0, 0, 1]))
        rows.append((k, place, None if rng.random() < 0.02 else at, "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KIND).drop("answered_by")
    got = {r["id"]: (r["answered_by"], r["answered_at"]) for r in lookups.answered(df, ["place"], "at", "id", hours).collect()}
    assert got == walked(rows, hours)


def test_no_lookups(spark):
    df = spark.createDataFrame([], KIND).drop("answered_by")
    assert lookups.answered(df, ["place"], "at", "id").collect() == []
