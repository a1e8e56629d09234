"""Queries on live events, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadrisk.functions import clock, text
from roadrisk.operators import cleaning, realtime, trips
from roadrisk.plans.registry import query, shared
from roadrisk.plans.relations import Inputs
from roadrisk.plans.trip_queries import DOUBLE_FEATURES, INTEGER_FEATURES, driver_sql, trip_sql

IDLE = realtime.DAY  # events are sparse here, so that patterns occur
AS_OF_LIVE = "2024-01-30 22:00:00"
BUCKET = 200

LIMIT = "CASE road_type WHEN 'residential' THEN 25 WHEN 'arterial' THEN 35 WHEN 'highway' THEN 65 WHEN 'interstate' THEN 75 ELSE 35 END"
shared(
    "t_flagged",
    f"""SELECT *, speed_mph > 1.2E0 * speed_limit AS is_speeding, harsh_braking OR harsh_acceleration AS is_harsh
FROM (SELECT *, {LIMIT} AS speed_limit FROM telematics_events) e""",
)
shared(
    "t_events_scored",
    """SELECT *, CASE WHEN harsh_braking THEN 0.1E0 ELSE 0.0E0 END + CASE WHEN harsh_acceleration THEN 0.08E0 ELSE 0.0E0 END
  + CASE WHEN is_speeding THEN 0.15E0 ELSE 0.0E0 END + CASE WHEN phone_usage THEN 0.12E0 ELSE 0.0E0 END AS base_score,
  concat_ws('|', CASE WHEN harsh_braking THEN 'harsh_braking' END, CASE WHEN harsh_acceleration THEN 'harsh_acceleration' END,
    CASE WHEN is_speeding THEN 'speeding' END, CASE WHEN phone_usage THEN 'phone_usage' END) AS base_events,
  concat_ws('|', CASE WHEN harsh_braking THEN 'Harsh braking detected' END, CASE WHEN harsh_acceleration THEN 'Harsh acceleration detected' END,
    CASE WHEN is_speeding THEN 'Speeding: ' || CAST(speed_mph AS VARCHAR) || ' mph in ' || CAST(speed_limit AS VARCHAR) || ' mph zone' END,
    CASE WHEN phone_usage THEN 'Phone usage while driving' END) AS base_alerts FROM t_flagged""",
)


def session_sql(source: str, idle: int) -> str:
    return f"""SELECT *, CAST(1 + sum(CASE WHEN gap > {idle}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY driver_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT *, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY driver_id ORDER BY timestamp, event_id)) AS gap FROM {source}) g"""


shared("t_session_day", session_sql("t_events_scored", IDLE))
shared("t_session_hour", session_sql("t_events_scored", realtime.HOUR))
shared(
    "t_patterns",
    """SELECT *, base_score + CASE WHEN n >= 3 AND harsh >= 3 THEN 0.2E0 ELSE 0.0E0 END + CASE WHEN n >= 3 AND fast >= 3 THEN 0.25E0 ELSE 0.0E0 END AS risk_score,
  concat_ws('|', nullif(base_events, ''), CASE WHEN harsh >= 3 THEN 'pattern_harsh_driving' END, CASE WHEN fast >= 3 THEN 'pattern_speeding' END) AS events_text,
  concat_ws('|', nullif(base_alerts, ''), CASE WHEN harsh >= 3 THEN 'Pattern of harsh driving detected' END, CASE WHEN fast >= 3 THEN 'Repeated speeding violations detected' END) AS alerts_text
FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (is_harsh) OVER w AS harsh, count(*) FILTER (is_speeding) OVER w AS fast FROM t_session_day
      WINDOW w AS (PARTITION BY driver_id, session ORDER BY timestamp, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)) p""",
)
shared(
    "t_rolling",
    """SELECT *, avg(risk_score) OVER (PARTITION BY driver_id, session ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS avg_risk FROM t_patterns""",
)
shared(
    "t_alerts",
    """SELECT *, CASE WHEN risk_score > 0.3E0 THEN 'high' ELSE 'medium' END AS severity,
  'Risk Alert for Driver ' || driver_id || ': ' || replace(alerts_text, '|', ', ') AS message FROM t_patterns WHERE alerts_text <> ''""",
)


def listed(df: DataFrame) -> DataFrame:
    """Text form of the two lists."""
    return df.withColumn("events_text", F.array_join("risk_events", "|")).withColumn(
        "alerts_text", F.array_join("immediate_alerts", "|")
    )


def patterned(i: Inputs) -> DataFrame:
    return realtime.risk_patterns(i.telematics_events, IDLE)


@query(
    "jn_speed_limit",
    keep="event_id road_type speed_limit",
    sql=f"SELECT event_id, road_type, {LIMIT} AS speed_limit FROM telematics_events",
)
def _(i):
    return i.telematics_events.withColumn("speed_limit", realtime.speed_limit())


@query(
    "batch_event_risk",
    keep="event_id driver_id events_text alerts_text",
    nums="risk_score",
    sql="SELECT event_id, driver_id, base_score AS risk_score, base_events AS events_text, base_alerts AS alerts_text FROM t_events_scored",
)
def _(i):
    return listed(realtime.score_events(i.telematics_events))


@query("win_idle_session", keep="event_id driver_id session", sql="SELECT * FROM t_session_hour")
def _(i):
    return realtime.idle_sessions(i.telematics_events)


@query(
    "win_recent_cache",
    keep="event_id driver_id recency",
    sql=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id ORDER BY timestamp DESC, event_id DESC) AS recency,
  max(session) OVER (PARTITION BY driver_id) AS live, max(timestamp) OVER (PARTITION BY driver_id) AS last_time
FROM ({session_sql("telematics_events", 4 * realtime.HOUR)}) s WHERE timestamp <= TIMESTAMP '{AS_OF_LIVE}') r
WHERE session = live AND recency <= 101 AND epoch_us(TIMESTAMP '{AS_OF_LIVE}') - epoch_us(last_time) < {4 * realtime.HOUR}000000""",
)
def _(i):
    return realtime.recent_cache(i.telematics_events, AS_OF_LIVE, idle_seconds=4 * realtime.HOUR)


@query(
    "win_risk_patterns",
    keep="event_id driver_id events_text alerts_text",
    nums="risk_score",
    sql="SELECT * FROM t_patterns",
)
def risk_patterns(i):
    return listed(patterned(i))


@query("win_rolling_risk", keep="event_id driver_id", nums="risk_score avg_risk", sql="SELECT * FROM t_rolling")
def _(i):
    return realtime.risk_history(i.telematics_events, IDLE, IDLE)


@query(
    "snk_latest_risk_batch",
    keep="driver_id trip_id timestamp event_id",
    nums="risk_score",
    sql=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver_id, trip_id ORDER BY timestamp DESC, event_id DESC) AS rn FROM t_patterns) l
WHERE rn = 1 AND timestamp <= TIMESTAMP '{AS_OF_LIVE}' AND epoch_us(TIMESTAMP '{AS_OF_LIVE}') - epoch_us(timestamp) < 3600000000""",
)
def _(i):
    return realtime.latest_risk(patterned(i), AS_OF_LIVE)


@query(
    "fn_alert_text",
    keep="event_id driver_id severity message subject",
    nums="risk_score",
    sql="SELECT *, 'Telematics Risk Alert - ' || upper(severity) AS subject FROM t_alerts",
)
def _(i):
    return realtime.alerts(patterned(i))


@query(
    "src_event_envelope",
    keep="event_id driver_id trip_id timestamp harsh_braking phone_usage road_type ingestion_timestamp",
    nums="speed_mph acceleration",
    sql="SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS ingestion_timestamp FROM telematics_events",
)
def _(i):
    events = i.telematics_events
    sent = realtime.envelopes(events, clock.ntz("2024-02-01 00:00:00"))
    fields = ", ".join(
        f"{f.name} {'string' if f.name == 'timestamp' else f.dataType.simpleString()}"
        for f in events.select("event_id", *realtime.EVENT_FIELDS).schema.fields
    )
    return realtime.read_envelopes(sent, f"{fields}, ingestion_timestamp string")


BUCKET_KEY = "driver_id, bucket"
shared(
    "t_buckets",
    f"""SELECT * FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY driver_id ORDER BY timestamp, event_id, seq) - 1) / {BUCKET}) AS BIGINT) AS bucket,
  count(*) OVER (PARTITION BY driver_id) AS n FROM telematics_raw) b WHERE (bucket + 1) * {BUCKET} <= n""",
)
shared(
    "t_bucket_points",
    "SELECT * FROM t_buckets WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND speed_mph BETWEEN 0 AND 200",
)
shared("t_bucket_trips", trip_sql("t_bucket_points", "bucket, driver_id, trip_id"))
shared("t_bucket_features", driver_sql("t_bucket_trips", BUCKET_KEY))


@query(
    "win_count_buckets",
    keep="driver_id bucket period_start " + INTEGER_FEATURES,
    nums=DOUBLE_FEATURES,
    sql="SELECT * FROM t_bucket_features",
)
def _(i):
    full = realtime.full_buckets(i.telematics_raw, BUCKET)
    return trips.features_of_all_drivers(full, group=("bucket",))
