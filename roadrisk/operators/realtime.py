"""Live-event operators on tables: the batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.config import (
    DEFAULT_SPEED_LIMIT,
    EVENT_ALERTS,
    PATTERN_ALERTS,
    SPEED_LIMITS,
    STREAM_RULES,
    StreamRules,
)
from roadrisk.functions import clock, text
from roadrisk.functions.scores import lookup
from roadrisk.operators.sequence import rolling, with_position, with_sessions

EVENT_ORDER = ("timestamp", ("event_id",))
HOUR = 3600
DAY = 86_400
RECENT_EVENTS = 101
EVENT_FIELDS = (
    "driver_id", "trip_id", "timestamp", "latitude", "longitude", "speed_mph", "acceleration",
    "harsh_braking", "harsh_acceleration", "phone_usage", "weather_condition", "road_type",
)


def speed_limit() -> Column:
    return lookup(F.col("road_type"), SPEED_LIMITS, DEFAULT_SPEED_LIMIT)


def with_flags(events: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    """Speed limit and the harsh and speeding flag of each event."""
    return (
        events.withColumn("speed_limit", speed_limit())
        .withColumn("is_speeding", F.col("speed_mph") > F.col("speed_limit") * rules.speed_factor)
        .withColumn(
            "is_harsh",
            F.coalesce("harsh_braking", F.lit(False)) | F.coalesce("harsh_acceleration", F.lit(False)),
        )
    )


def with_score(events: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    """Flags and the stateless score of each event."""
    points = {
        "harsh_braking": rules.braking_score,
        "harsh_acceleration": rules.acceleration_score,
        "is_speeding": rules.speeding_score,
        "phone_usage": rules.phone_score,
    }
    score = F.lit(0.0)
    for flag, value in points.items():
        score = score + F.when(F.col(flag), value).otherwise(0.0)
    return with_flags(events, rules).withColumn("risk_score", score)


def with_texts(scored: DataFrame) -> DataFrame:
    """Event names and alert texts from the flags.

    Kept apart from the score, so that histories shuffle flags and numbers only and the texts are
    made at the end.
    """
    flags = {
        "harsh_braking": "harsh_braking",
        "harsh_acceleration": "harsh_acceleration",
        "speeding": "is_speeding",
        "phone_usage": "phone_usage",
    }
    names = text.present(*[(F.col(flag), name) for name, flag in flags.items()])
    words = text.present(
        *[
            (F.col(flag), text.filled(EVENT_ALERTS[name], speed=F.col("speed_mph"), limit=F.col("speed_limit")))
            for name, flag in flags.items()
        ]
    )
    return scored.withColumn("risk_events", names).withColumn("immediate_alerts", words)


def score_events(events: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    """Stateless score, event names and alert texts; valid on tables and on streams."""
    return with_texts(with_score(events, rules))


def _patterns(rules: StreamRules) -> tuple[Column, Column]:
    """Harsh and speeding pattern, from the counts of recent events."""
    enough = F.col("recent_events") >= 3
    return (
        enough & (F.col("recent_harsh") >= rules.pattern_count),
        enough & (F.col("recent_speeding") >= rules.pattern_count),
    )


def add_pattern_score(scored: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    harsh, speeding = _patterns(rules)
    return scored.withColumn(
        "risk_score",
        F.col("risk_score")
        + F.when(harsh, rules.harsh_pattern_score).otherwise(0.0)
        + F.when(speeding, rules.speeding_pattern_score).otherwise(0.0),
    )


def with_all_texts(scored: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    """Texts of the event itself, then those of the patterns."""
    hits = list(zip(_patterns(rules), PATTERN_ALERTS.items()))
    names = text.present(*[(hit, name) for hit, (name, _) in hits])
    words = text.present(*[(hit, alert) for hit, (_, alert) in hits])
    return (
        with_texts(scored)
        .withColumn("risk_events", F.concat("risk_events", names))
        .withColumn("immediate_alerts", F.concat("immediate_alerts", words))
    )


def idle_sessions(events: DataFrame, idle_seconds: int = HOUR) -> DataFrame:
    """Session number per driver: a longer pause than the idle time starts a new one."""
    return with_sessions(events, ("driver_id",), *EVENT_ORDER, {"session": idle_seconds})


def _with_recent_counts(events: DataFrame, session: str, rules: StreamRules) -> DataFrame:
    """Harsh and speeding events among the newest eleven of the session, the current one included."""
    return rolling(
        events,
        ("driver_id", session),
        "position",
        rules.pattern_rows,
        {
            "recent_events": lambda frame: F.count("*").over(frame),
            "recent_harsh": lambda frame: F.count_if("is_harsh").over(frame),
            "recent_speeding": lambda frame: F.count_if("is_speeding").over(frame),
        },
    )


def _with_average(scored: DataFrame, session: str, rules: StreamRules) -> DataFrame:
    return rolling(
        scored,
        ("driver_id", session),
        "position",
        rules.rolling_rows,
        {"avg_risk": lambda frame: F.avg("risk_score").over(frame)},
    )


def risk_patterns(
    events: DataFrame, idle_seconds: int = HOUR, rules: StreamRules = STREAM_RULES
) -> DataFrame:
    """Scored events with the pattern terms; speeding counts each event's own speeding flag."""
    placed = idle_sessions(with_score(events, rules), idle_seconds)
    scored = add_pattern_score(_with_recent_counts(placed, "session", rules), rules)
    return with_all_texts(scored, rules).drop("session", "position")


def rolling_risk(
    scored: DataFrame, idle_seconds: int = DAY, rules: StreamRules = STREAM_RULES
) -> DataFrame:
    """Mean of the last 100 scores of a driver, starting over after a day without events."""
    return _with_average(idle_sessions(scored, idle_seconds), "session", rules).drop("session", "position")


def risk_history(
    events: DataFrame,
    pattern_idle: int = HOUR,
    rolling_idle: int = DAY,
    rules: StreamRules = STREAM_RULES,
) -> DataFrame:
    """Scored events with pattern terms and the rolling mean; places and both kinds of sessions come
    from one pass. The batch twin of ``streaming.history.with_history``."""
    sessions = {"_pattern_session": pattern_idle, "_rolling_session": rolling_idle}
    placed = with_sessions(with_score(events, rules), ("driver_id",), *EVENT_ORDER, sessions)
    scored = add_pattern_score(_with_recent_counts(placed, "_pattern_session", rules), rules)
    averaged = _with_average(scored, "_rolling_session", rules)
    return with_all_texts(averaged, rules).drop(*sessions, "position")


def recent_cache(
    events: DataFrame, as_of: str, keep: int = RECENT_EVENTS, idle_seconds: int = HOUR
) -> DataFrame:
    """Newest events of each driver whose history is still live at ``as_of``.

    The newest rows are picked first, already before the shuffle; only they can belong to the
    live session, which ends at the first pause longer than the idle time.
    """
    newest = Window.partitionBy("driver_id").orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    upto = newest.rowsBetween(Window.unboundedPreceding, 0)
    gap = clock.seconds_between(F.lag("timestamp").over(newest), F.col("timestamp")) > idle_seconds
    age = clock.seconds_between(clock.ntz(as_of), F.first("timestamp").over(upto))
    return (
        events.filter(F.col("timestamp") <= clock.ntz(as_of))
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= keep)
        .withColumn("_break", F.coalesce(gap.cast("int"), F.lit(0)))
        .withColumn("_breaks", F.sum("_break").over(upto))
        .withColumn("_age", age)
        .filter((F.col("_breaks") == 0) & (F.col("_age") < idle_seconds))
        .drop("_break", "_breaks", "_age")
    )


def latest_risk(scored: DataFrame, as_of: str | None = None, ttl_seconds: int = HOUR) -> DataFrame:
    """Latest assessment per driver and trip; with ``as_of`` only those still alive then.

    An aggregate and not a window, so it is combined before the shuffle.
    """
    latest = F.max_by(
        F.struct("event_id", "risk_score", "risk_events", "immediate_alerts"),
        F.struct("timestamp", "event_id"),
    )
    table = (
        scored.groupBy("driver_id", "trip_id")
        .agg(F.max("timestamp").alias("timestamp"), latest.alias("_latest"))
        .select("driver_id", "trip_id", "timestamp", "_latest.*")
    )
    if as_of is None:
        return table
    age = clock.seconds_between(clock.ntz(as_of), F.col("timestamp"))
    return table.filter((age >= 0) & (age < ttl_seconds))


def alerts(scored: DataFrame, rules: StreamRules = STREAM_RULES) -> DataFrame:
    """Alert record of every event that raised one; valid on tables and on streams."""
    return (
        scored.filter(F.size("immediate_alerts") > 0)
        .withColumn("severity", text.alert_severity(F.col("risk_score"), rules.severe_above))
        .withColumn("message", text.alert_message(F.col("driver_id"), F.col("immediate_alerts")))
        .withColumn("subject", text.alert_subject(F.col("severity")))
        .withColumnRenamed("immediate_alerts", "alerts")
        .select(
            "event_id", "driver_id", "trip_id", "timestamp", "alerts", "risk_score", "severity",
            "message", "subject",
        )
    )


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def envelopes(events: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Event as ingested: key, JSON text of the twelve fields, the event id where there is one, and the ingestion time."""
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    ready = events.select(
        *[c for c in events.columns if c == "event_id"],
        *[iso(F.col(n)).alias(n) if n == "timestamp" else F.col(n) for n in EVENT_FIELDS],
        iso(stamp).alias("ingestion_timestamp"),
    )
    return ready.select(F.col("driver_id").alias("key"), F.to_json(F.struct(*ready.columns)).alias("value"))


def _parsed(envelopes_: DataFrame, schema: str) -> DataFrame:
    return envelopes_.select("*", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))


def _readable() -> Column:
    known = F.col("e.driver_id").isNotNull() & F.col("e.timestamp").try_cast("timestamp_ntz").isNotNull()
    return F.coalesce(known, F.lit(False))


def read_envelopes(envelopes_: DataFrame, schema: str) -> DataFrame:
    """Parsed envelopes; malformed texts are left out, see ``malformed_envelopes``."""
    return (
        _parsed(envelopes_, schema)
        .filter(_readable())
        .select("e.*")
        .withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz"))
        .withColumn("ingestion_timestamp", F.col("ingestion_timestamp").try_cast("timestamp_ntz"))
    )


def malformed_envelopes(envelopes_: DataFrame, schema: str) -> DataFrame:
    """The texts that ``read_envelopes`` leaves out, as they came, with the reason; valid on tables and on streams."""
    reason = (
        F.when(F.col("value").isNull(), "no text")
        .when(F.col("e").isNull() | F.col("e.driver_id").isNull(), "no driver or not JSON")
        .otherwise("no usable time")
    )
    return _parsed(envelopes_, schema).filter(~_readable()).select(*envelopes_.columns, reason.alias("reason"))


def full_buckets(points: DataFrame, size: int = 1000) -> DataFrame:
    """Points of every full run of ``size`` points of a driver, with the bucket number."""
    ties = tuple(c for c in ("event_id", "seq") if c in points.columns)
    numbered = with_position(points, ("driver_id",), "timestamp", ties)
    return (
        numbered.withColumn("bucket", F.floor((F.col("position") - 1) / size))
        .filter((F.col("bucket") + 1) * size <= F.col("key_rows"))
        .drop("position", "key_rows")
    )
