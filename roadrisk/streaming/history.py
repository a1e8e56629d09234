"""Per-driver history on a stream: keyed state with a few numbers per driver.

The functions below run per driver and micro-batch. A driver's rows of one micro-batch are bounded
by the trigger size of the source (files or offsets per trigger), never by the driver's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, LongType, StructType

from roadrisk.config import STREAM_RULES, TRIP_RULES, StreamRules, TripRules
from roadrisk.operators.realtime import DAY, HOUR, add_pattern_score, with_all_texts, with_score
from roadrisk.streaming.sources import with_event_time

HISTORY_STATE = "last_us bigint, flags array<int>, scores array<double>"


def _trailing(values: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Sum over the last ``rows`` values up to each place, not before its start."""
    totals = np.concatenate(([0.0], np.cumsum(values)))
    end = np.arange(1, len(values) + 1)
    return totals[end] - totals[np.maximum(end - rows, starts)]


def _starts(breaks: np.ndarray) -> np.ndarray:
    """Index at which the run of each place begins."""
    return np.maximum.accumulate(np.where(breaks, np.arange(len(breaks)), 0))


def with_history(
    events: DataFrame,
    pattern_idle: int = HOUR,
    rolling_idle: int = DAY,
    rules: StreamRules = STREAM_RULES,
    delay: str | None = None,
) -> DataFrame:
    """Scored events with their pattern terms and the rolling mean score of the driver.

    Events of a micro-batch are taken in time order. One that is older than the last event already
    seen counts as coming right after it. State: flags of the last ten events and the last 99 scores.
    Without a delay no event is dropped and every driver's state is kept; with one, state is freed when the
    longer idle time has passed, and events later than the delay are dropped by the watermark.
    """
    scored = with_event_time(with_score(events, rules)).withColumn("_us", F.unix_micros("timestamp"))
    if delay is not None:
        scored = scored.withWatermark("timestamp", delay)
    expiry = max(pattern_idle, rolling_idle)
    schema = StructType(list(scored.schema.fields))
    for name in ("recent_events", "recent_harsh", "recent_speeding"):
        schema = schema.add(name, LongType())
    schema = schema.add("avg_risk", DoubleType())
    keep_flags, keep_scores = rules.pattern_rows - 1, rules.rolling_rows - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches), ignore_index=True)
        new = new.sort_values(["_us", "event_id"], ignore_index=True)
        times = new["_us"].to_numpy("int64")
        last, flags, scores = state.get if state.exists else (None, [], [])
        if last is not None:
            times = np.maximum(times, last)
        gaps = np.diff(times, prepend=times[0] if last is None else last) / 1e6

        def run(old: np.ndarray, fresh: np.ndarray, idle: int) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate((old, fresh))
            breaks = np.concatenate((np.zeros(len(old), bool), gaps > idle))
            return values, _starts(breaks)

        old_flags = np.array(flags, dtype="int64")
        fresh_flags = new["is_harsh"].to_numpy(bool) * 1 + new["is_speeding"].to_numpy(bool) * 2
        values, starts = run(old_flags, fresh_flags, pattern_idle)
        at = slice(len(old_flags), None)
        rows = rules.pattern_rows
        counts = _trailing(np.ones(len(values)), starts, rows)[at].astype("int64")
        harsh = _trailing(values % 2, starts, rows)[at].astype("int64")
        fast = _trailing(values // 2, starts, rows)[at].astype("int64")
        total = (
            new["risk_score"].to_numpy()
            + np.where((counts >= 3) & (harsh >= rules.pattern_count), rules.harsh_pattern_score, 0.0)
            + np.where((counts >= 3) & (fast >= rules.pattern_count), rules.speeding_pattern_score, 0.0)
        )
        kept_flags = values[max(starts[-1], len(values) - keep_flags) :]

        values, starts = run(np.array(scores, dtype="float64"), total, rolling_idle)
        at = slice(len(scores), None)
        sums = _trailing(values, starts, rules.rolling_rows)[at]
        means = sums / _trailing(np.ones(len(values)), starts, rules.rolling_rows)[at]
        kept_scores = values[max(starts[-1], len(values) - keep_scores) :]

        state.update(
            (
                int(times[-1]),
                [int(v) for v in kept_flags],
                [float(v) for v in kept_scores],
            )
        )
        if delay is not None:
            free_at = int(times[-1]) // 1000 + expiry * 1000 + 1
            state.setTimeoutTimestamp(max(free_at, state.getCurrentWatermarkMs() + 1))
        yield new.assign(recent_events=counts, recent_harsh=harsh, recent_speeding=fast, avg_risk=means)

    kept = scored.groupBy("driver_id").applyInPandasWithState(
        step, schema, HISTORY_STATE, "append", GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    )
    zone_free = kept.drop("_us").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return with_all_texts(add_pattern_score(zone_free, rules), rules)


def _usable_points(rows: pd.DataFrame, rules: TripRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the valid points, and the trip number and microseconds of each: made once for all runs of the rows."""

    def within(name: str, low: float, high: float) -> np.ndarray:
        values = rows[name].to_numpy("float64", na_value=np.nan)
        return (values >= low) & (values <= high)

    trips, _ = pd.factorize(rows["trip_id"])
    valid = within("latitude", -90, 90) & within("longitude", -180, 180) & within("speed_mph", 0, rules.max_speed_mph)
    valid &= (trips >= 0) & rows["timestamp"].notna().to_numpy()
    places = np.flatnonzero(valid)
    return places, trips[places], rows["timestamp"].to_numpy("datetime64[us]")[places].astype("int64")


def _usable_from(points: tuple[np.ndarray, np.ndarray, np.ndarray], begin: int, end: int, rules: TripRules) -> int:
    """Number of rows of ``begin`` to ``end`` after which some trip of them is long enough to give features; beyond them if
    none is."""
    places, trips, times = points
    low, high = np.searchsorted(places, (begin, end))
    trips, times = trips[low:high], times[low:high]
    if not len(times):
        return end - begin + 1
    if (times[1:] >= times[:-1]).all():
        _, first, trip = np.unique(trips, return_index=True, return_inverse=True)
        spans = times - times[first][trip]
    else:  # kept points may be later than those that arrived after them
        by_trip = pd.Series(times).groupby(trips)
        spans = (by_trip.cummax() - by_trip.cummin()).to_numpy()
    found = np.flatnonzero(spans / 1e6 / 60 >= rules.min_trip_minutes)
    return int(places[low + found[0]]) - begin + 1 if len(found) else end - begin + 1


def with_full_buckets(points: DataFrame, size: int = 1000, retry: bool = False, rules: TripRules = TRIP_RULES) -> DataFrame:
    """Points of each run of ``size`` points of a driver, emitted when the run is complete.

    With ``retry``, a complete run without a trip that gives features is kept: it grows with each further point and is emitted
    with the first one that completes such a trip.

    State: the points of the open run (fewer than ``size``, but for runs that are kept) and the number of emitted runs.
    """
    schema = StructType(list(points.schema.fields)).add("bucket", LongType())
    columns = points.columns
    order = [c for c in ("timestamp", "event_id", "seq") if c in columns]

    def ends_of(rows: pd.DataFrame) -> list[int]:
        if not retry:
            return list(range(size, len(rows) + 1, size))
        if len(rows) < size:
            return []
        points = _usable_points(rows, rules)
        ends, begin = [], 0
        while begin + size <= len(rows):
            need = _usable_from(points, begin, begin + size, rules)
            if need > size:
                need = _usable_from(points, begin, len(rows), rules)
            if need > len(rows) - begin:
                break
            begin += max(size, need)
            ends.append(begin)
        return ends

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True).sort_values(order, ignore_index=True)
        done, waiting = state.get if state.exists else (0, None)
        if waiting:
            with pa.ipc.open_stream(pa.py_buffer(waiting)) as reader:
                new = pd.concat([reader.read_pandas(), new], ignore_index=True)
        ends = ends_of(new)
        complete = ends[-1] if ends else 0
        rest = pa.Table.from_pandas(new.iloc[complete:], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as writer:
            writer.write_table(rest)
        state.update((done + len(ends), sink.getvalue().to_pybytes()))
        if complete:
            full = new.iloc[:complete]
            yield full.assign(bucket=done + np.searchsorted(ends, np.arange(complete), side="right"))

    return points.groupBy("driver_id").applyInPandasWithState(
        step, schema, "done bigint, waiting binary", "append", GroupStateTimeout.NoTimeout
    )
