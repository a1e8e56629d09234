"""Ordered work over long histories of one key, split so that no key becomes one task.

A plain window over ``partitionBy(key)`` sends the whole history of a key to one task; a key that
holds a third of all rows would stop the job. Here a history is cut into time slots. Rows are
shuffled by (key, slot), and what crosses a slot border comes from a summary with one row per
(key, slot), which is pre-aggregated before its shuffle. The summary of one key is bounded by its
time span divided by the slot width, not by its rows. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from roadrisk.config import SLOT_SECONDS, STRETCH_ROWS
from roadrisk.functions import clock
from roadrisk.functions.clock import epoch_seconds, seconds_between

SLOT = "_slot"
LEAF_MICROS = 65_536  # time of a leaf, which holds one moment per microsecond at most
LEAVES = 65_536  # of a block
NO_TIME_SLOT = 2**62  # rows without a time come last


def time_slot(time: str, slot_seconds: int = SLOT_SECONDS) -> Column:
    return F.coalesce(F.floor(epoch_seconds(F.col(time)) / slot_seconds), F.lit(NO_TIME_SLOT))


def _order(time: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(time).asc_nulls_last(), *[F.col(name).asc_nulls_last() for name in ties]]


def slot_window(keys: Sequence[str], time: str, ties: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, SLOT).orderBy(*_order(time, ties))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str],
    columns: Sequence[str],
    slot_seconds: int = SLOT_SECONDS,
    slot: Column | None = None,
) -> DataFrame:
    """Add ``prev_<column>``: the value in the previous row of the key.

    Where rows are ordered by a number instead of a time, ``slot`` gives the cut, growing with it.
    """
    slotted = df.withColumn(SLOT, time_slot(time, slot_seconds) if slot is None else slot)
    tails = slotted.groupBy(*keys, SLOT).agg(
        F.max_by(F.struct(*columns), F.struct(time, *ties)).alias("_tail")
    )
    carried = tails.select(
        *keys, SLOT, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SLOT)).alias("_carried")
    ).filter(F.col("_carried").isNotNull())
    previous = F.coalesce(
        F.lag(F.struct(*columns)).over(slot_window(keys, time, ties)), F.col("_carried")
    )
    return (
        slotted.join(carried, [*keys, SLOT], "left")
        .withColumn("_previous", previous)
        .select(*df.columns, *[F.col("_previous")[name].alias(f"prev_{name}") for name in columns])
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str],
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Add ``position``, the row number from 1 inside the key, and ``key_rows``, its row count."""
    slotted = df.withColumn(SLOT, time_slot(time, slot_seconds))
    earlier = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, SLOT)
        .agg(F.count("*").alias("_rows"))
        .select(
            *keys,
            SLOT,
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("key_rows"),
        )
    )
    rank = F.row_number().over(slot_window(keys, time, ties))
    return (
        slotted.join(offsets, [*keys, SLOT])
        .withColumn("position", F.col("_offset") + rank)
        .select(*df.columns, "position", "key_rows")
    )


def with_sessions(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    ties: Sequence[str],
    gaps: Mapping[str, int],
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Add session numbers and ``position``, the row number from 1 inside the key.

    ``gaps`` names one session column per pause in seconds; a longer pause than that starts the next
    session. Slots are never wider than the shortest gap, so a pause that counts can only lie between
    two slots, and all sessions follow from the first and last time of every slot.
    """
    slotted = df.withColumn(SLOT, time_slot(time, min(slot_seconds, *gaps.values())))
    in_key = Window.partitionBy(*keys).orderBy(SLOT)
    so_far = in_key.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_key.rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        slotted.groupBy(*keys, SLOT)
        .agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.count("*").alias("_rows"))
        .withColumn("_pause", seconds_between(F.col("_first"), F.lag("_last").over(in_key)))
        .select(
            *keys,
            SLOT,
            *[(1 + F.count_if(F.col("_pause") > gap).over(so_far)).alias(name) for name, gap in gaps.items()],
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    rank = F.row_number().over(slot_window(keys, time, ties))
    return (
        slotted.join(slots, [*keys, SLOT])
        .withColumn("position", F.col("_offset") + rank)
        .select(*df.columns, *gaps, "position")
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    rows: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Add columns over the last ``rows`` rows of the key, the current one included.

    A history is cut into stretches by position; the last ``rows - 1`` rows of a stretch are copied
    to the next one, where they only fill frames and are dropped afterwards.
    """
    if rows - 1 > stretch_rows:
        raise ValueError("a stretch must hold a whole frame")
    place = F.col(position) - 1
    stretch = F.floor(place / stretch_rows)
    needed_next = (place % stretch_rows) >= stretch_rows - (rows - 1)
    frame = Window.partitionBy(*keys, "_stretch").orderBy(position).rowsBetween(-(rows - 1), 0)
    return (
        df.withColumn(
            "_stretch",
            F.explode(
                F.when(needed_next, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
            ),
        )
        .withColumns({name: make(frame) for name, make in columns.items()})
        .filter(F.col("_stretch") == stretch)
        .drop("_stretch")
    )


def as_of_tables(
    requests: DataFrame,
    keys: Sequence[str],
    request_time: str,
    tables: Mapping[str, tuple[DataFrame, str, str]],
    leaf_micros: int = LEAF_MICROS,
) -> DataFrame:
    """Add a struct column for each entry of ``tables`` (rows, time, tie): its latest row at or before the request, the
    one with the largest tie among equal times, null if there is none.

    All tables are answered in one pass over distinct (key, time), since requests of one moment have one answer: rows of a
    moment are merged before they are shuffled. Moments are cut into leaves, which hold one row per microsecond at most, leaves
    into blocks of LEAVES; the latest rows are carried over leaves inside a block and over blocks of a key. No step thus gathers a
    busy key, hour or second. A request without a key or time has no observation.
    """
    kinds = {}
    for name, (rows, _, tie) in tables.items():
        payload = rows.select(F.struct(*[c for c in rows.columns if c not in keys]).alias("p"), F.struct(tie).alias("t"))
        kinds[name] = tuple(payload.schema[c].dataType for c in "pt")

    def known(df: DataFrame, time: str) -> DataFrame:
        return df.dropna(subset=[*keys, time]).withColumn("_at", clock.epoch_micros(F.col(time)))

    parts = known(requests, request_time).select(
        *keys, "_at", *[F.lit(None).cast(kind).alias(f"_{k}{name}") for name, pair in kinds.items() for k, kind in zip("pt", pair, strict=True)]
    )
    for name, (rows, time, tie) in tables.items():
        payload = {"p": F.struct(*[c for c in rows.columns if c not in keys]), "t": F.struct(tie)}
        values = [
            (payload[k] if other == name else F.lit(None).cast(kind)).alias(f"_{k}{other}")
            for other, pair in kinds.items()
            for k, kind in zip("pt", pair, strict=True)
        ]
        parts = parts.unionByName(known(rows, time).select(*keys, "_at", *values))
    seen = [f"_p{name}" for name in tables]
    moments = (
        parts.groupBy(*keys, "_at")
        .agg(*[F.max_by(f"_p{name}", f"_t{name}").alias(f"_p{name}") for name in tables])
        .withColumn("_leaf", F.floor(F.col("_at") / F.lit(leaf_micros)))
        .repartition(*keys, "_leaf")  # read twice, by leaf
    )

    def last(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
        known_at = {name: F.when(F.col(name).isNotNull(), F.col(order)) for name in seen}
        return df.groupBy(*by).agg(*[F.max_by(name, known_at[name]).alias(name) for name in seen])

    def carried(df: DataFrame, by: Sequence[str], order: str, prefix: str) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({prefix + name: F.last(name, ignorenulls=True).over(before) for name in seen})

    leaves = last(moments, [*keys, "_leaf"], "_at").withColumn("_block", F.floor(F.col("_leaf") / LEAVES)).repartition(*keys, "_block")
    blocks = carried(last(leaves, [*keys, "_block"], "_leaf"), keys, "_block", "_b").drop(*seen)
    leaves = carried(leaves, [*keys, "_block"], "_leaf", "_l").join(blocks, [*keys, "_block"])
    leaves = leaves.select(*keys, "_leaf", *[F.coalesce(f"_l{name}", f"_b{name}").alias(f"_c{name}") for name in seen])
    upto = Window.partitionBy(*keys, "_leaf").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    answers = moments.join(leaves, [*keys, "_leaf"]).select(
        *keys, "_at", *[F.coalesce(F.last(f"_p{name}", ignorenulls=True).over(upto), F.col(f"_c_p{name}")).alias(name) for name in tables]
    )
    asked = requests.withColumn("_at", clock.epoch_micros(F.col(request_time)))
    return asked.join(answers, [*keys, "_at"], "left").select(*requests.columns, *tables)


def as_of(
    requests: DataFrame,
    observations: DataFrame,
    keys: Sequence[str],
    request_time: str,
    observation_time: str,
    observation_tie: str,
    max_age_seconds: int | None = None,
    slot_seconds: float = LEAF_MICROS / 1e6,
) -> DataFrame:
    """Add ``observation``: the latest observation row at or before the request, null if none."""
    tables = {"observation": (observations, observation_time, observation_tie)}
    matched = as_of_tables(requests, keys, request_time, tables, round(slot_seconds * 1e6))
    return not_older(matched, request_time, "observation", observation_time, max_age_seconds)


def not_older(
    matched: DataFrame, request_time: str, name: str, observation_time: str, max_age_seconds: int | None
) -> DataFrame:
    """Observations beyond an age become null."""
    if max_age_seconds is None:
        return matched
    age = seconds_between(F.col(request_time), F.col(f"{name}.{observation_time}"))
    return matched.withColumn(name, F.when(age <= max_age_seconds, F.col(name)))


def numbered(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """Number the rows of a table with unique keys from 0, in the order of (hash prefix, key).

    The prefix cuts the table into 65,536 even buckets, so only bucket totals meet in one task.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, 4))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + rank - 1)
        .select(*df.columns, name)
    )
