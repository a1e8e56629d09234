"""Streaming jobs run over the event file to its end, compared with the SQL of their batch twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from roadrisk.functions import clock
from roadrisk.operators import realtime
from roadrisk.operators.ml import with_synthetic_target
from roadrisk.plans.event_queries import AS_OF_LIVE, BUCKET, IDLE, listed
from roadrisk.plans.registry import query, shared
from roadrisk.plans.relations import Inputs, spark_text
from roadrisk.plans.trip_queries import DOUBLE_FEATURES, INTEGER_FEATURES, driver_sql, trip_sql
from roadrisk.sources.scratch import new_folder
from roadrisk.streaming import jobs
from roadrisk.streaming.history import with_history
from roadrisk.streaming.sources import file_stream

INGESTED = "2024-02-01 10:30:00"


def streamed(i: Inputs, name: str) -> DataFrame:
    """A relation over the event table, as a stream."""
    # as a glob the table may be one file or a folder of files
    events = file_stream(i.spark, f"{i.folder}/{{events.parquet}}", i.table("events").schema, pattern=None)
    return relation_of(i, events, name)


def finished(i: Inputs, start, name: str) -> str:
    """Run a job to the end of its input and give its output folder."""
    folder, checkpoint = new_folder(i.spark, name), new_folder(i.spark, f"{name}-state")
    start(folder, checkpoint).awaitTermination()
    return folder


def stored(i: Inputs, stream: DataFrame, name: str) -> DataFrame:
    folder = finished(i, lambda out, state: jobs.to_files(stream, out, state), name)
    return i.spark.read.schema(stream.schema).parquet(folder)  # also where no row came


PARTS = 4


def unordered(i: Inputs, name: str, run, copies: int = 1) -> str:
    """Run a job over the event table in PARTS files that each hold events of the whole time span, so that most rows of the
    later ones are late, started again for every file; every event is in ``copies`` files. Gives the output folder."""
    source, folder, checkpoint = (new_folder(i.spark, f"{name}{part}") for part in ("-source", "", "-state"))
    events = i.table("events")
    for part in range(PARTS):
        events.filter((F.col("event_id") + part) % PARTS < copies).write.mode("append").parquet(source)
        arriving = file_stream(i.spark, source, events.schema)
        run(relation_of(i, arriving, name), folder, checkpoint).awaitTermination()
    return folder


def relation_of(i: Inputs, events: DataFrame, name: str) -> DataFrame:
    events.createOrReplaceTempView("events_arriving")
    return i.spark.sql(re.sub(r"\bFROM events\b", "FROM events_arriving", spark_text(name)))


@query(
    "src_event_stream",
    keep="event_id driver_id trip_id timestamp",
    nums="speed_mph",
    sql="SELECT * FROM telematics_events",
)
def _(i):
    return stored(i, streamed(i, "telematics_events"), "events")


@query(
    "str_event_risk",
    keep="event_id driver_id events_text alerts_text",
    nums="risk_score",
    sql="SELECT event_id, driver_id, base_score AS risk_score, base_events AS events_text, base_alerts AS alerts_text FROM t_events_scored",
)
def _(i):
    return listed(stored(i, realtime.score_events(streamed(i, "telematics_events")), "scores"))


def histories(i: Inputs) -> DataFrame:
    return with_history(streamed(i, "telematics_events"), IDLE, IDLE)


@query(
    "str_event_risk_patterns",
    keep="event_id driver_id events_text alerts_text",
    nums="risk_score",
    sql="SELECT * FROM t_patterns",
)
def _(i):
    return listed(stored(i, histories(i), "patterns"))


@query("str_rolling_risk", keep="event_id driver_id", nums="risk_score avg_risk", sql="SELECT * FROM t_rolling")
def _(i):
    return stored(i, histories(i), "rolling")


@query(
    "str_alerts",
    keep="event_id driver_id severity message",
    nums="risk_score",
    sql="SELECT * FROM t_alerts",
)
def _(i):
    return stored(i, realtime.alerts(histories(i)), "alerts")


@query(
    "snk_alerts",
    keep="key event_id driver_id severity",
    nums="risk_score",
    sql="SELECT *, driver_id AS key FROM t_alerts",
)
def _(i):
    topic = new_folder(i.spark, "alert-topic")

    def send(messages: DataFrame, number: int) -> None:  # in place of a broker
        messages.write.mode("overwrite").parquet(f"{topic}/{jobs.BATCH}={number}")

    finished(i, lambda out, state: jobs.publish_to_topic(histories(i), out, state, send), "alert-outbox")
    record = "event_id bigint, driver_id string, severity string, risk_score double"
    messages = i.spark.read.schema("key string, value string").parquet(f"{topic}/{jobs.BATCH}=*")
    return messages.select("key", F.from_json("value", record).alias("r")).select("key", "r.*")


def landed(i: Inputs) -> DataFrame:
    folder = finished(
        i,
        lambda out, state: jobs.land_events(
            streamed(i, "telematics_events"), out, state, clock.ntz(INGESTED)
        ),
        "lake",
    )
    schema = i.telematics_events.schema.add("ingestion_timestamp", "timestamp_ntz")
    for name in ("year", "month", "day"):
        schema = schema.add(name, "string")
    return i.spark.read.schema(schema).parquet(folder)


LAKE_SQL = f"""SELECT *, TIMESTAMP '{INGESTED}' AS ingestion_timestamp, '2024' AS year, '02' AS month, '01' AS day FROM telematics_events"""


@query("snk_event_lake", keep="event_id driver_id year month day", nums="speed_mph", sql=LAKE_SQL)
def _(i):
    return landed(i)


@query("str_lake_sink", keep="event_id trip_id ingestion_timestamp year month day", sql=LAKE_SQL)
def _(i):
    return landed(i).filter("year = '2024' AND month = '02' AND day = '01'")


@query(
    "snk_latest_risk",
    keep="driver_id trip_id timestamp event_id",
    nums="risk_score",
    sql=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id, trip_id ORDER BY timestamp DESC, event_id DESC) AS rn FROM t_patterns) l
WHERE rn = 1 AND timestamp <= TIMESTAMP '{AS_OF_LIVE}' AND epoch_us(TIMESTAMP '{AS_OF_LIVE}') - epoch_us(timestamp) < 3600000000""",
)
def _(i):
    folder = finished(i, lambda out, state: jobs.store_latest_risk(histories(i), out, state), "latest")
    return jobs.latest_risk_table(i.spark, folder, AS_OF_LIVE)


@query(
    "str_count_buckets",
    keep="driver_id bucket period_start " + INTEGER_FEATURES,
    nums=DOUBLE_FEATURES,
    sql="SELECT * FROM t_bucket_features",
)
def _(i):
    folder = finished(
        i,
        lambda out, state: jobs.count_bucket_features(streamed_points(i), out, state, BUCKET),
        "buckets",
    )
    return jobs.read_batches(i.spark, folder).drop(jobs.BATCH)


def streamed_points(i: Inputs) -> DataFrame:
    """Points as a stream; the generator is spelled as a projection on the event stream."""
    return streamed(i, "telematics_raw")


@query(
    "str_rate_windows",
    keep="window_start client_id requests over_limit",
    sql="""SELECT date_trunc('hour', timestamp) AS window_start, client_id, count(*) AS requests, greatest(count(*) - 3, 0) AS over_limit
FROM api_usage GROUP BY 1, 2""",
)
def _(i):
    folder = unordered(i, "api_usage", jobs.merge_request_counts)
    return jobs.request_counts(i.spark, folder, limit=3)


@query("str_dedup_late", keep="event_id driver_id", sql="SELECT event_id, driver_id FROM telematics_events")
def _(i):
    folder = unordered(i, "telematics_events", jobs.land_once, copies=2)
    return jobs.read_landed(i.spark, folder, i.telematics_events.schema)


shared("t_upload_trips", trip_sql("t_upload_points", "upload_id, driver_id, trip_id"))
shared("t_upload_points", "SELECT *, event_id AS upload_id FROM t_points")
shared("t_upload_features", driver_sql("t_upload_trips", "driver_id, upload_id"))


@query(
    "str_upload_rescore",
    keep="driver_id upload_id",
    nums="risk_score",
    sql="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY upload_id DESC) AS rn,
  greatest(0.0E0, least(1.0E0, 0.5E0 + least(harsh_braking_count / 50.0E0, 0.2E0) + least(harsh_acceleration_count / 50.0E0, 0.2E0)
  + least(over_speed_ratio, 0.2E0) + least(phone_usage_ratio, 0.1E0) + least(night_driving_ratio * 0.1E0, 0.1E0))) AS risk_score FROM t_upload_features) s WHERE rn = 1""",
)
def _(i):
    uploads = streamed_points(i).withColumn("upload_id", F.col("event_id"))
    folder = finished(
        i,
        lambda out, state: jobs.rescore_uploads(
            uploads, out, state, lambda features: with_synthetic_target(features, noise_sd=0.0)
        ),
        "rescore",
    )
    return jobs.newest_per_key(jobs.read_batches(i.spark, folder), ("driver_id",))
