"""Streaming jobs over several files, late and repeated events, and restarts, against batch twins."""

from __future__ import annotations

import random
import tempfile
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadrisk import schemas
from roadrisk.functions import clock
from roadrisk.operators import realtime, trips
from roadrisk.streaming import history, jobs, sources

START = datetime(2024, 1, 1)


def folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def events(spark, n=240, seed=1):
    """Events of three drivers in time order, one of them with most of the rows."""
    rng = random.Random(seed)
    rows, at = [], START
    for k in range(n):
        at += timedelta(seconds=rng.choice([5, 60, 400, 4000, 90000]) if rng.random() < 0.5 else 20)
        driver = "a" if rng.random() < 0.7 else rng.choice("bc")
        rows.append(
            (k, driver, f"{driver}-{at.date()}", at, 40.0, -74.0, float(rng.randint(10, 100)), 0.0, rng.random() < 0.4,
             rng.random() < 0.2, rng.random() < 0.2, "clear", rng.choice(["residential", "highway", "dirt"]))
        )
    return spark.createDataFrame(rows, schemas.EVENTS)


def write_files(df, target, cuts, key="event_id"):
    """One file per range of ids, oldest first."""
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col(key) >= low) & (F.col(key) < high)).coalesce(1).write.mode("append").parquet(target)
        time.sleep(1.1)  # files are taken in the order of their modification time


def run_history(spark, source, out, state):
    stream = history.with_history(sources.file_stream(spark, source, files_per_trigger=1), 3600, 86400)
    jobs.to_files(stream, out, state).awaitTermination()
    return {r["event_id"]: r for r in spark.read.parquet(out).collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key]["risk_events"] == row["risk_events"], key
        assert got[key]["immediate_alerts"] == row["immediate_alerts"]
        assert got[key]["risk_score"] == pytest.approx(row["risk_score"])
        assert got[key]["avg_risk"] == pytest.approx(row["avg_risk"])


def test_history_over_files_and_a_restart_equals_the_batch(spark):
    df = events(spark)
    want = {r["event_id"]: r for r in realtime.risk_history(df, 3600, 86400).collect()}
    assert any("pattern_harsh_driving" in r["risk_events"] for r in want.values())
    source, out, state = folder(), f"{folder()}/out", folder()
    write_files(df, source, [0, 50, 51, 130])
    run_history(spark, source, out, state)
    write_files(df, source, [130, 240])
    assert_same(run_history(spark, source, out, state), want)


@pytest.mark.parametrize("delay", [None, "10 minutes"])
def test_late_events(spark, delay):
    """Late events count as arriving now. Only a delay drops those beyond it, from the third micro-batch on."""
    df = events(spark, 60)
    late = df.filter("event_id = 30").withColumns(
        {"event_id": F.lit(1000).cast("long"), "timestamp": F.col("timestamp") - F.expr("INTERVAL 5 MINUTES")}
    )
    lost = late.withColumns(
        {"event_id": F.lit(1001).cast("long"), "timestamp": F.col("timestamp") - F.expr("INTERVAL 2 DAYS")}
    )
    source, out = folder(), f"{folder()}/out"
    write_files(df.filter("event_id <= 30"), source, [0, 20, 31])
    write_files(late.union(lost), source, [1000, 1002])
    write_files(df.filter("event_id > 30"), source, [31, 60])
    stream = history.with_history(sources.file_stream(spark, source, files_per_trigger=1), 3600, 86400, delay=delay)
    jobs.to_files(stream, out, folder()).awaitTermination()
    got = {r["event_id"] for r in spark.read.parquet(out).collect()}
    assert got == {*range(60), 1000} | (set() if delay else {1001})


def test_very_late_event_in_the_second_batch(spark):
    """State that would have expired before the watermark does not end the query."""
    df = events(spark, 40)
    late = df.filter("event_id = 0").withColumn("event_id", F.lit(1000).cast("long")).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 9 DAYS"))
    late = late.withColumn("driver_id", F.lit("z"))
    for delay in (None, "30 days"):
        source, out = folder(), f"{folder()}/out"
        write_files(df, source, [0, 40])
        write_files(late, source, [1000, 1001])
        stream = history.with_history(sources.file_stream(spark, source, files_per_trigger=1), 60, 60, delay=delay)
        jobs.to_files(stream, out, folder()).awaitTermination()
        assert {r["event_id"] for r in spark.read.parquet(out).collect()} == {*range(40), 1000}


def test_unordered_files_lose_nothing(spark):
    df = events(spark, 200)
    source = folder()
    df.repartition(4).write.mode("append").parquet(source)
    stream = sources.file_stream(spark, source, files_per_trigger=1)
    for make in (sources.without_repeats, lambda s: history.with_history(s, 3600, 86400)):
        out = f"{folder()}/out"
        jobs.to_files(make(stream), out, folder()).awaitTermination()
        assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(200))
    log = stream.selectExpr("timestamp", "driver_id client_id")
    out = folder()
    jobs.count_requests(log, out, folder()).awaitTermination()
    counts = jobs.newest_per_key(jobs.read_batches(spark, out), ("window_start", "client_id"))
    assert counts.agg({"requests": "sum"}).first()[0] == 200


@pytest.mark.parametrize("name", ["src_event_stream", "str_rolling_risk", "snk_event_lake", "str_rate_windows", "str_dedup_late"])
def test_registered_streams_read_a_table_of_many_files(spark, name):
    from roadrisk.plans.catalog import QUERIES
    from tests.conftest import SMALL

    many = folder()
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(4).write.parquet(f"{many}/events.parquet")
    one, parts = QUERIES[name].run(spark, SMALL), QUERIES[name].run(spark, many)
    assert parts.count() == one.count() > 0


def test_repeated_events_are_dropped(spark):
    df = events(spark, 80)
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 40])
    write_files(df, source, [30, 80])
    stream = sources.without_repeats(sources.file_stream(spark, source, files_per_trigger=1), delay="400 days")
    jobs.to_files(stream, out, folder()).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == list(range(80))


def test_latest_risk_and_alerts(spark):
    df = events(spark)
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 100, 240])
    scored = realtime.score_events(sources.file_stream(spark, source, files_per_trigger=1))
    jobs.store_latest_risk(scored, out, folder()).awaitTermination()
    batch = realtime.score_events(df)
    as_of = str(df.agg(F.max("timestamp")).first()[0])
    for moment in (None, as_of):
        got = {tuple(r[:4]) for r in jobs.latest_risk_table(spark, out, moment).collect()}
        assert got == {tuple(r[:4]) for r in realtime.latest_risk(batch, moment).collect()}
    sent = f"{folder()}/sent"
    jobs.publish_alerts(scored, sent, folder()).awaitTermination()
    assert spark.read.parquet(sent).count() == realtime.alerts(batch).count()


def points(spark, n=95):
    rows = []
    for k in range(n):
        driver = "a" if k % 3 else "b"
        rows.append((START + timedelta(seconds=40 * k), driver, f"{driver}{k // 30}", k, 40 + k / 1000, -74.0, 30.0 + k % 9, 0.0, 30.0, "urban", "rain", "day", 0, 0, 1, 0))
    return spark.createDataFrame(rows, schemas.POINTS)


def test_count_buckets_span_files(spark):
    df = points(spark)
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 33, 35, 95], "seq")
    stream = sources.file_stream(spark, source, schemas.POINTS, files_per_trigger=1)
    jobs.count_bucket_features(stream, out, folder(), 20).awaitTermination()
    got = {(r["driver_id"], r["bucket"]): r for r in jobs.read_batches(spark, out).collect()}
    full = realtime.full_buckets(df.withColumn("event_id", F.lit(0)), 20)
    want = trips.features_of_all_drivers(full, group=("bucket",)).collect()
    assert len(want) == 4 and got.keys() == {(r["driver_id"], r["bucket"]) for r in want}
    for row in want:
        same = got[row["driver_id"], row["bucket"]]
        assert same["total_mileage"] == pytest.approx(row["total_mileage"])
        assert same["trip_frequency"] == row["trip_frequency"]


def test_a_bucket_without_a_valid_trip_is_kept_and_tried_again(spark):
    """Runs of ten points: the first has only broken positions, later ones too short trips; against a walk point by point."""
    rng = random.Random(8)
    rows = []
    for k in range(160):
        driver = "a" if k % 4 else "b"
        broken = k < 30 or rng.random() < 0.2
        trip = f"{driver}{k // 40}" if k % 80 < 40 else f"{driver}-{k}"  # for a while each point is a trip of its own
        rows.append((START + timedelta(seconds=15 * k), driver, trip, k, 95.0 if broken else 40.0, -74.0, 30.0, 0.0, 30.0, "urban", "rain", "day", 0, 0, 1, 0))
    df = spark.createDataFrame(rows, schemas.POINTS)
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 7, 8, 60, 61, 160], "seq")
    stream = sources.file_stream(spark, source, schemas.POINTS, files_per_trigger=1)
    jobs.count_bucket_features(stream, out, folder(), 10).awaitTermination()
    got = {(r["driver_id"], r["bucket"]): r["trip_frequency"] for r in jobs.read_batches(spark, out).collect()}
    want, kept, done = {}, {"a": [], "b": []}, {"a": 0, "b": 0}
    for at, driver, trip, _, lat, *_ in rows:
        kept[driver].append((at, trip, lat))
        if len(kept[driver]) >= 10:
            spans = {}
            for time_, name, y in kept[driver]:
                if y <= 90:
                    first, _ = spans.get(name, (time_, time_))
                    spans[name] = (first, time_)
            usable = sum((b - a).total_seconds() >= 120 for a, b in spans.values())
            if usable:
                want[driver, done[driver]] = usable
                kept[driver], done[driver] = [], done[driver] + 1
    assert got == want and len(want) > 4


def test_request_windows(spark):
    log = spark.range(300).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id * 47)")).alias("timestamp"),
        (F.col("id") % 3).alias("client_id"),
        F.col("id").alias("event_id"),
    )
    source, out = folder(), f"{folder()}/out"
    write_files(log, source, [0, 90, 300])
    stream = sources.file_stream(spark, source, log.schema, files_per_trigger=1)
    jobs.count_requests(stream, out, folder(), limit=20).awaitTermination()
    got = jobs.newest_per_key(jobs.read_batches(spark, out), ("window_start", "client_id"))
    from roadrisk.operators.feeds import rate_windows

    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(got.collect()) == key(rate_windows(log, "1 hour", 20).collect())


def test_lake_is_partitioned_by_ingestion_day(spark):
    df = events(spark, 20)
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 20])
    stream = sources.file_stream(spark, source)
    jobs.land_events(stream, out, folder(), clock.ntz("2024-02-09 00:00:00")).awaitTermination()
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(out)
    assert {(int(r["month"]), int(r["day"])) for r in back.collect()} == {(2, 9)} and back.count() == 20


def test_upload_scores_follow_the_newest_usable_upload(spark):
    df = points(spark).withColumn("upload_id", F.floor(F.col("seq") / 30))
    source, out = folder(), f"{folder()}/out"
    write_files(df, source, [0, 30, 60, 95], "seq")
    stream = sources.file_stream(spark, source, df.schema, files_per_trigger=1)
    job = jobs.rescore_uploads(stream, out, folder(), lambda f: f.withColumn("risk_score", F.col("avg_speed")))
    job.awaitTermination()
    got = {r["driver_id"]: r for r in jobs.newest_per_key(jobs.read_batches(spark, out), ("driver_id",)).collect()}
    features = trips.features_of_all_drivers(df, group=("upload_id",)).collect()
    for driver in "ab":
        newest = max((r for r in features if r["driver_id"] == driver), key=lambda r: r["upload_id"])
        assert got[driver]["upload_id"] == newest["upload_id"]
        assert got[driver]["risk_score"] == pytest.approx(newest["avg_speed"])


def test_envelopes_lead_to_histories_and_alerts(spark):
    df = events(spark, 60)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields} | {"timestamp": "string"}
    text = ", ".join(f"{n} {types[n]}" for n in ("event_id", *realtime.EVENT_FIELDS)) + ", ingestion_timestamp string"
    back = realtime.read_envelopes(realtime.envelopes(df), text)
    scored, want = realtime.risk_history(back, 3600, 86400), realtime.risk_history(df, 3600, 86400)
    assert_same({r["event_id"]: r for r in scored.collect()}, {r["event_id"]: r for r in want.collect()})
    assert realtime.alerts(scored).count() == realtime.alerts(want).count() > 0


def test_envelopes_skip_malformed_texts(spark):
    df = events(spark, 5)
    sent = realtime.envelopes(df, clock.ntz("2024-02-01 00:00:00"))
    broken = spark.createDataFrame([("a", "{not json"), ("a", None)], "key string, value string")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types["timestamp"] = "string"
    text = ", ".join(f"{n} {types[n]}" for n in realtime.EVENT_FIELDS) + ", ingestion_timestamp string"
    back = realtime.read_envelopes(sent.union(broken), text)
    assert back.count() == 5
    assert {r["timestamp"] for r in back.collect()} == {r["timestamp"] for r in df.collect()}


def test_malformed_envelopes_are_named(spark):
    good = '{"driver_id": "a", "timestamp": "2024-01-01T00:00:00.000000"}'
    texts = [good, "{not json", None, '{"driver_id": "a", "timestamp": "yesterday"}', '{"driver_id": "a"}', '{"timestamp": "2024-01-01T00:00:00"}', "[]"]
    df = spark.createDataFrame([("k", t) for t in texts], "key string, value string")
    schema = "driver_id string, timestamp string, ingestion_timestamp string"
    assert [r["driver_id"] for r in realtime.read_envelopes(df, schema).collect()] == ["a"]
    left = {r["value"]: r["reason"] for r in realtime.malformed_envelopes(df, schema).collect()}
    assert set(left) == set(texts) - {good}
    assert left[None] == "no text" and left["{not json"] == "no driver or not JSON" and left[texts[3]] == "no usable time" == left[texts[4]]


def test_usable_runs_need_one_look_at_the_points():
    """The first row of each run that completes a long enough trip, against a walk, for points in and out of order."""
    from roadrisk.config import TRIP_RULES
    from roadrisk.streaming import history

    rng = random.Random(3)
    for turn in range(60):
        rows = []
        for _ in range(rng.randrange(1, 90)):
            at = None if rng.random() < 0.05 else START + timedelta(microseconds=rng.randrange(600) * rng.choice([1_000_000, 999_999]))
            rows.append((at, rng.choice(["a", "b", None]), rng.choice([40.0, 40.0, 95.0, None]), -74.0, rng.choice([30.0, 30.0, 250.0, None])))
        if turn % 2:
            rows.sort(key=lambda r: (r[0] is None, r[0] or START))
        frame = pd.DataFrame(rows, columns=["timestamp", "trip_id", "latitude", "longitude", "speed_mph"])
        frame["timestamp"] = frame["timestamp"].astype("datetime64[ns]")
        points = history._usable_points(frame, TRIP_RULES)
        for begin in range(0, len(rows), 7):
            for end in (begin + 5, len(rows)):
                spans, want = {}, min(end, len(rows)) - begin + 1
                for k, (at, trip, lat, _, mph) in enumerate(rows[begin:end]):
                    if None in (at, trip, lat, mph) or lat > 90 or mph > 200:
                        continue
                    first, last = spans.get(trip, (at, at))
                    spans[trip] = first, last = min(first, at), max(last, at)
                    if (last - first).total_seconds() >= 120:
                        want = k + 1
                        break
                assert history._usable_from(points, begin, min(end, len(rows)), TRIP_RULES) == want
