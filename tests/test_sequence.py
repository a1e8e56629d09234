"""Slot and stretch operators against pandas on histories with one very busy key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadrisk.functions import clock
from roadrisk.operators import sequence
from tests.conftest import plain_rows

START = datetime(2024, 3, 9, 22, 0, 0)


def history(seed: int, rows: int = 400) -> pd.DataFrame:
    """Half of the rows belong to one key; times repeat, cluster and pause."""
    rng = random.Random(seed)
    clock = {k: START for k in "abcd"}
    data = []
    for n in range(rows):
        key = "a" if rng.random() < 0.5 else rng.choice("bcd")
        clock[key] += timedelta(seconds=rng.choice([0, 0, 1, 7, 59, 600, 1800, 3600, 3601, 7300, 90000]))
        data.append((n, key, clock[key], float(rng.randint(0, 50)), rng.random() < 0.4))
    rng.shuffle(data)
    return pd.DataFrame(data, columns=["id", "key", "time", "value", "flag"])


def frame(spark, pdf):
    return spark.createDataFrame(
        plain_rows(pdf), "id long, key string, time timestamp_ntz, value double, flag boolean"
    )


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slot", [60, 3600, 10**7])
def test_previous_row_crosses_slots(spark, seed, slot):
    pdf = history(seed)
    got = sequence.with_previous(frame(spark, pdf), ["key"], "time", ["id"], ["value", "id"], slot).toPandas()
    want = pdf.sort_values(["key", "time", "id"])
    want["prev_id"] = want.groupby("key")["id"].shift()
    merged = got.merge(want[["id", "prev_id"]], on="id", suffixes=("", "_want"))
    assert len(merged) == len(pdf)
    assert merged["prev_id"].fillna(-1).tolist() == merged["prev_id_want"].fillna(-1).tolist()


@pytest.mark.parametrize("slot", [60, 3600])
def test_position(spark, slot):
    pdf = history(3)
    got = sequence.with_position(frame(spark, pdf), ["key"], "time", ["id"], slot).toPandas().set_index("id")
    want = pdf.sort_values(["key", "time", "id"])
    want["position"] = want.groupby("key").cumcount() + 1
    want = want.set_index("id")
    assert got["position"].sort_index().tolist() == want["position"].sort_index().tolist()
    assert got["key_rows"].to_dict() == pdf.set_index("id")["key"].map(pdf["key"].value_counts()).to_dict()


def test_two_kinds_of_sessions(spark):
    pdf = history(4)
    got = sequence.with_sessions(
        frame(spark, pdf), ["key"], "time", ["id"], {"short": 3600, "long": 86400}
    ).toPandas().set_index("id").sort_index()
    want = pdf.sort_values(["key", "time", "id"])
    pause = want.groupby("key")["time"].diff().dt.total_seconds().fillna(0)
    for name, gap in (("short", 3600), ("long", 86400)):
        want[name] = (pause > gap).groupby(want["key"]).cumsum() + 1
    want = want.set_index("id").sort_index()
    assert got["short"].tolist() == want["short"].tolist()
    assert got["long"].tolist() == want["long"].tolist()
    assert want["short"].max() > want["long"].max() > 1


@pytest.mark.parametrize("stretch", [10, 37, 100_000])
def test_rolling_over_stretches(spark, stretch):
    pdf = history(5)
    placed = sequence.with_sessions(frame(spark, pdf), ["key"], "time", ["id"], {"session": 90_000 - 1})
    got = sequence.rolling(
        placed,
        ["key", "session"],
        "position",
        11,
        {
            "total": lambda w: F.sum("value").over(w),
            "rows": lambda w: F.count("*").over(w),
            "flags": lambda w: F.count_if("flag").over(w),
        },
        stretch,
    ).toPandas()
    assert len(got) == len(pdf)
    ordered = got.sort_values(["key", "position"])
    groups = ordered.groupby(["key", "session"])
    want = groups["value"].rolling(11, min_periods=1).sum().reset_index(drop=True)
    assert ordered["total"].tolist() == pytest.approx(want.tolist())
    assert ordered["rows"].tolist() == groups.cumcount().add(1).clip(upper=11).tolist()


def test_rolling_refuses_short_stretches(spark):
    with pytest.raises(ValueError):
        sequence.rolling(spark.range(1), ["id"], "id", 100, {}, 50)


@pytest.mark.parametrize("slot", [60, 3600])
@pytest.mark.parametrize("age", [None, 1800])
def test_as_of(spark, slot, age):
    seen, asked = history(6, 150), history(7, 200)
    got = sequence.as_of(
        frame(spark, asked).withColumnRenamed("time", "at"),
        frame(spark, seen).select("key", F.col("id").alias("obs"), F.col("time").alias("seen_at")),
        ["key"],
        "at",
        "seen_at",
        "obs",
        age,
        slot,
    ).select("id", "observation.obs").toPandas()
    assert len(got) == len(asked)
    result = got.set_index("id")["obs"]
    for row in asked.itertuples():
        fits = seen[(seen["key"] == row.key) & (seen["time"] <= row.time)].sort_values(["time", "id"])
        if age is not None and len(fits) and (row.time - fits.iloc[-1]["time"]).total_seconds() > age:
            fits = fits.iloc[:0]
        if len(fits):
            assert result[row.id] == fits.iloc[-1]["id"]
        else:
            assert pd.isna(result[row.id])


def test_numbering_is_dense_and_repeatable(spark):
    df = spark.range(3000).selectExpr("concat('driver_', id) AS driver_id")
    first = sequence.numbered(df.repartition(7), "driver_id").toPandas()
    second = sequence.numbered(df.repartition(3), "driver_id").toPandas()
    assert sorted(first["row_index"]) == list(range(3000))
    assert dict(zip(first.driver_id, first.row_index)) == dict(zip(second.driver_id, second.row_index))


def test_rows_without_time_come_last(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1L, 'a', CAST(NULL AS TIMESTAMP_NTZ), 1.0D, true), "
        "(2L, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00', 2.0D, true) t(id, key, time, value, flag)"
    )
    rows = sequence.with_previous(df, ["key"], "time", ["id"], ["id"]).collect()
    assert {r["id"]: r["prev_id"] for r in rows} == {1: 2, 2: None}


def test_one_busy_key_is_spread_over_tasks(spark):
    """All rows of one key: every step over them runs in several tasks."""
    rows = spark.range(20_000).selectExpr(
        "id", "'a' AS key", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 30) AS time",
        "CAST(id AS DOUBLE) AS value", "true AS flag",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = sequence.with_position(rows, ["key"], "time", ["id"])
        frames = sequence.rolling(
            placed, ["key"], "position", 11, {"total": lambda w: F.sum("value").over(w)}, 1000
        )
        for df in (placed, frames, sequence.with_previous(rows, ["key"], "time", ["id"], ["value"])):
            sizes = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert len(sizes) > 2 and max(r["count"] for r in sizes) < 12_000
        assert frames.agg(F.sum("position")).first()[0] == 20_000 * 20_001 // 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("leaf", [1_000, 65_536, 10**8])
def test_as_of_several_tables_in_one_pass(spark, leaf):
    """Two tables at once, with equal times, missing keys and times, against brute force."""
    rng = random.Random(leaf)

    def moment():
        return None if rng.random() < 0.03 else START + timedelta(days=rng.choice([0, 0, 0, 40, -30_000]), microseconds=rng.choice([0, 1, 5, 10**6, rng.randrange(10**10)]))

    def rows(n):
        return [(k if rng.random() < 0.9 else None, rng.choice(["a", "a", "b", None]), moment(), rng.random()) for k in range(n)]

    asked, first, second = rows(300), rows(200), rows(60)
    asked = [(k, *r[1:]) for k, r in enumerate(asked)]
    tables = {}
    for name, data in (("first", first), ("second", second)):
        df = spark.createDataFrame(data, "obs long, key string, seen_at timestamp_ntz, value double")
        tables[name] = (df, "seen_at", "obs")
    got = sequence.as_of_tables(
        spark.createDataFrame(asked, "id long, key string, at timestamp_ntz, first_value double"), ["key"], "at", tables, leaf
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        for name, data in (("first", first), ("second", second)):
            fits = [x for x in data if x[1] is not None and x[2] is not None and r["key"] == x[1] and r["at"] is not None and x[2] <= r["at"]]
            best = max(fits, key=lambda x: (x[2], x[0] is not None, x[0] or 0), default=None)
            assert (best is None) == (r[name] is None)
            if best is not None:
                assert (r[name]["seen_at"], r[name]["obs"]) == (best[2], best[0])


def test_a_burst_of_one_second_is_spread_over_tasks(spark):
    """All requests and observations of one station in one second: no task gets most of them at any step."""
    rows = spark.range(20_000).selectExpr(
        "id", "'a' AS key", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.00005) AS at"
    )
    seen = rows.filter("id % 3 = 0").selectExpr("id AS obs", "key", "at AS seen_at")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sequence.as_of_tables(rows, ["key"], "at", {"seen": (seen, "seen_at", "obs")})
        sizes = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(sizes) > 2 and max(r["count"] for r in sizes) < 12_000
        assert found.filter("seen.obs <> id - id % 3 OR seen IS NULL").isEmpty()
        leaves = rows.groupBy(F.floor(clock.epoch_micros(F.col("at")) / sequence.LEAF_MICROS)).count().collect()
        assert len(leaves) >= 15 and max(r["count"] for r in leaves) <= 1311
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
