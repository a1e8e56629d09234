"""Shards along a Hilbert curve over document metadata.

Source, language, size and id are quantised to ``BITS`` bits each and give a cell; the cell's place on the Hilbert
curve orders the documents, so that neighbours in a shard are close in all four dimensions and files can be skipped by any
of them. Within a cell equal texts stand together. The order is cut into runs of equal numbers of rows (law ``rows``: counts at most one apart).

All work is done by DataFrame functions. Only metadata is sorted; the sort deals ranges of the whole order
(cell, checksum, size, id), so neither a crowded cell nor a text with many copies fills a task. Row numbers come
from counts per range, of which there are as many as shuffle partitions.

Defined cases: a null text has size 16 and checksum 0; a null source, language or id is cell 0 of its dimension, null
ids come first in their cell; repeated rows each take a slot; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadrisk.llm.shared import written

SHARDS = 40
BITS = 6
DIMENSIONS = 4
OVERHEAD = 16  # bytes of a row besides its text


def size_cell(size: Column) -> Column:
    """Quarter octaves of the size, from 16 bytes on."""
    length = F.length(F.bin(size))
    quarter = F.expr("shiftright(size, cast(length(bin(size)) - 3 as int)) & 3")
    return F.least(F.lit((1 << BITS) - 1), (length - 5) * 4 + quarter).cast("int")


def cells(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the cell x0..x3 of each document."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + OVERHEAD
    crc = F.coalesce(F.crc32(F.col("text").cast("string").cast("binary")), F.lit(0)).cast("long")
    held = written(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l")))
    first, last = held.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (int(last) - int(first) >> BITS) + 1 if first is not None else 1
    mask = (1 << BITS) - 1

    def named(column: str) -> Column:
        return F.coalesce(F.crc32(F.col(column).cast("binary")), F.lit(0)).bitwiseAND(F.lit(mask)).cast("int")

    place = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(int(first or 0)).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)"))
    return held.select(
        "doc_id", "size", "text_crc32", named("s").alias("x0"), named("l").alias("x1"), size_cell(F.col("size")).alias("x2"),
        F.coalesce(F.least(place, F.lit(mask)), F.lit(0)).cast("int").alias("x3"),
    )


def on_curve(df: DataFrame) -> DataFrame:
    """Replaces the cell x0.. by ``curve``, its place on the Hilbert curve: rotations level by level, then Gray code."""
    axes = [f"x{k}" for k in range(DIMENSIONS)]
    for level in range(BITS - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in axes:
            turned = F.col(axis).bitwiseAND(F.lit(bit)) != 0
            if axis == "x0":
                df = df.withColumn("x0", F.when(turned, F.col("x0").bitwiseXOR(F.lit(below))).otherwise(F.col("x0")))
                continue
            swap = F.col("x0").bitwiseXOR(F.col(axis)).bitwiseAND(F.lit(below))
            df = df.withColumn("swap", F.when(turned, 0).otherwise(swap))
            df = df.withColumns({
                "x0": F.when(turned, F.col("x0").bitwiseXOR(F.lit(below))).otherwise(F.col("x0").bitwiseXOR(F.col("swap"))),
                axis: F.col(axis).bitwiseXOR(F.col("swap")),
            })
    for before, axis in zip(axes, axes[1:], strict=False):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for level in range(BITS - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(F.lit(1 << level)) != 0, (1 << level) - 1).otherwise(0))
    df = df.withColumn("swap", turn).withColumns({a: F.col(a).bitwiseXOR(F.col("swap")) for a in axes})
    curve = F.lit(0)
    for level in range(BITS - 1, -1, -1):
        for axis in axes:
            curve = curve * 2 + F.shiftright(axis, level).bitwiseAND(F.lit(1))
    return df.withColumn("curve", curve.cast("long")).drop("swap", *axes)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of each document."""
    order = ["curve", "text_crc32", "size", "doc_id"]
    ranged = on_curve(cells(docs)).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("number", F.monotonically_increasing_id()))
    ranged = ranged.select("*", F.shiftright("number", 33).alias("range"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")).drop("number")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(everything).alias("total"))
    rows = ranged.join(starts, "range").withColumn("place", F.col("start") + F.col("inside"))
    rows = rows.withColumn("shard", F.expr(f"cast((place * {shards}) div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole documents (ids must be unique) as one folder per shard, in the order of slots."""
    own = placed(docs, shards).select("doc_id", "shard", "slot")
    rows = docs.join(own, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.drop("slot").write.partitionBy("shard").parquet(path)
