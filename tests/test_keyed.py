"""Keyed tables, the outbox of alerts, merged counts and landing once, over many and repeated batches."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from roadrisk.operators import realtime
from roadrisk.operators.feeds import rate_windows
from roadrisk.sources import keyed
from roadrisk.streaming import jobs, sources
from tests.test_streaming import START, events, folder, write_files

KIND = "key long, at long, value string"


def newest(df):
    return df.groupBy("key").agg(F.max_by(F.struct("at", "value"), "at").alias("r")).select("key", "r.*")


def test_fifty_batches_leave_few_files_and_the_newest_rows(spark):
    out = folder()
    table = keyed.KeyedTable(spark, out, keyed.by_hash(["key"], 4), newest)
    schema = spark.createDataFrame([], KIND).schema
    assert table.read(schema).count() == 0
    rng, want = random.Random(1), {}
    for number in range(50):
        rows = [(rng.randrange(30), number * 10 + k, f"{number}-{k}") for k in range(rng.choice([0, 1, 5]))]
        table.merge(spark.createDataFrame(rows, KIND), number)
        if number % 7 == 0 and rows:  # the batch is run again
            table.merge(spark.createDataFrame(rows, KIND), number)
        for key, at, value in rows:
            want[key] = (at, value)
        if number % 10 == 9:
            assert {r["key"]: (r["at"], r["value"]) for r in table.read(schema).collect()} == want
    assert len(keyed.children(spark, f"{out}/lists")) <= 2
    kept = [name for v in keyed.children(spark, f"{out}/rows") for name in keyed.children(spark, f"{out}/rows/{v}") if name.startswith(keyed.BUCKET)]
    assert len(kept) <= 2 * 4


def test_a_batch_that_fails_before_its_list_is_not_seen(spark):
    out = folder()
    table = keyed.KeyedTable(spark, out, keyed.by_hash(["key"], 2), newest)
    table.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], KIND), 0)
    spark.createDataFrame([(1, 9, "lost", 0)], KIND + ", _bucket long").write.partitionBy("_bucket").parquet(f"{out}/rows/1")
    schema = spark.createDataFrame([], KIND).schema
    assert {tuple(r) for r in table.read(schema).collect()} == {(1, 1, "a"), (2, 1, "b")}
    table.merge(spark.createDataFrame([(1, 2, "c")], KIND), 1)
    assert {tuple(r) for r in table.read(schema).collect()} == {(1, 2, "c"), (2, 1, "b")}


def test_latest_risk_of_many_batches_equals_the_batch(spark):
    df = events(spark, 120)
    source, out, state = folder(), folder(), folder()
    write_files(df, source, [60, 120, 121])
    write_files(df, source, [0, 60])  # older events come later
    scored = realtime.score_events(sources.file_stream(spark, source, files_per_trigger=1))
    jobs.store_latest_risk(scored, out, state, buckets=3).awaitTermination()
    want = {tuple(r) for r in realtime.latest_risk(realtime.score_events(df)).select("driver_id", "trip_id", "timestamp", "event_id").collect()}
    got = {tuple(r)[:4] for r in jobs.latest_risk_table(spark, out, buckets=3).collect()}
    assert got == want


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, client_id long")


def test_late_requests_are_merged_into_their_windows(spark):
    rng = random.Random(3)
    rows = [(k, START + timedelta(minutes=rng.randrange(6000)), rng.choice([1, 1, 1, 2, 3])) for k in range(400)] + [(400, None, 1)]
    source, out, state = folder(), folder(), folder()
    log = log_rows(spark, rows)
    stream = sources.file_stream(spark, source, log.schema, files_per_trigger=1)
    for part in range(3):
        log.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        query = jobs.merge_request_counts(stream, out, state)
        query.awaitTermination()
        assert not query.lastProgress or not query.lastProgress["stateOperators"]
    got = sorted(tuple(r) for r in jobs.request_counts(spark, out, 20).filter("window_start IS NOT NULL").collect())
    assert got == sorted(tuple(r) for r in rate_windows(log.filter("timestamp IS NOT NULL"), "1 hour", 20).collect())


def test_events_land_once_however_late(spark):
    df = events(spark, 90)
    source, out, state = folder(), folder(), folder()
    stream = sources.file_stream(spark, source, files_per_trigger=1)
    for part in range(3):  # each event comes twice, and all files span the whole time
        df.filter((F.col("event_id") + part) % 3 < 2).coalesce(1).write.mode("append").parquet(source)
        jobs.land_once(stream, out, state).awaitTermination()
    landed = jobs.read_landed(spark, out, df.schema)
    assert sorted(r["event_id"] for r in landed.collect()) == list(range(90))
    assert landed.columns == df.columns


def test_a_repeated_micro_batch_publishes_once(spark):
    df = events(spark, 80)
    source, outbox, state = folder(), folder(), folder()
    write_files(df, source, [0, 40, 80])
    scored = realtime.score_events(sources.file_stream(spark, source, files_per_trigger=1))
    sent = []

    def send(messages, number):
        assert [(f.name, f.dataType.simpleString()) for f in messages.schema] == [
            ("key", "string"), ("value", "string"), ("headers", "array<struct<key:string,value:binary>>"),
        ]
        sent.extend((number, bytes(r["headers"][0]["value"]).decode()) for r in messages.collect())
        if number == 1 and not fail:
            fail.append(True)
            raise RuntimeError("the broker answered after the batch had failed")

    fail = []
    with pytest.raises(Exception, match="broker"):
        jobs.publish_to_topic(scored, outbox, state, send).awaitTermination()
    jobs.publish_to_topic(scored, outbox, state, send).awaitTermination()
    jobs.publish_to_topic(scored, outbox, folder(), send).awaitTermination()  # all batches again, under the same numbers
    want = sorted(r["event_id"] for r in realtime.alerts(realtime.score_events(df)).collect())
    ids = [name for _, name in sent]
    assert sorted(int(name.split(":")[1]) for name in set(ids)) == want
    first = [name for name in ids if name.startswith("0:")]
    assert len(first) == len(set(first))  # sent and marked: not sent again
    options = jobs.topic_options("host:1", "driver-alerts")
    assert options["kafka.bootstrap.servers"] == "host:1" and options["topic"] == "driver-alerts" and options["includeHeaders"] == "true"
