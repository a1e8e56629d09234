"""Helpers of the operators: shared folder, word ids, packed buckets, counting sketches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK_BYTES = 4_000_000  # text handled at once in a task
BATCH_BYTES = "8MB"  # sent to a Python worker at once
KEPT_WORDS = 200_000  # word ids a task remembers


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a new local one only where
    that is unset in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again, so that later steps depend neither
    on lost executors nor on a second evaluation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches are bounded by their bytes, unless it has a bound already: the default
    counts rows, and 10,000 long texts take hundreds of megabytes of each task several times over."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


# --- words -----------------------------------------------------------------------------------------


class WordIds(dict):
    """64-bit ids of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of ids become well spread hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * ODD


def grams(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` ids, by its start."""
    count = len(ids) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(length):
        total = total * ODD + ids[k : k + count]
    return mixed(total)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with about ``size`` bytes of text each, with their texts as bytes (or None).
    A longer text makes a slice of its own."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
        begin = held = 0
        for k, value in enumerate(values):
            more = len(value) if value else 0
            if k > begin and held + more > size:
                yield batch.slice(begin, k - begin), values[begin:k]
                begin, held = k, 0
            held += more
        if begin < len(values):
            yield batch.slice(begin), values[begin:]


# --- packed buckets --------------------------------------------------------------------------------


def packed(records: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Structured records as one row (bucket, payload) for each bucket that occurs."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
    width, data = records.dtype.itemsize, records.tobytes()
    offsets = np.r_[starts, len(bucket)].astype(np.int64) * width
    payload = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]
    ).cast(pa.binary())
    assert ends[-1] == len(bucket)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), payload], ["bucket", "payload"])


def unpacked(group: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("payload").to_pylist()), dtype)


def buckets_for(amount: int, each: int) -> int:
    """Number of buckets for groups of about ``each`` records; it grows with the data."""
    return max(16, -(-int(amount or 0) // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


# --- counting sketches -----------------------------------------------------------------------------


def summed_counts(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, slices: int = 32) -> np.ndarray:
    """Counters of a fixed number of cells, filled by ``add`` over all rows of ``df``.

    Each task sends its counters in slices; slices are added in two rounds, so that no task gets all of them.
    The result has ``size`` numbers, whatever the input."""
    width = -(-size // slices)

    def counts(batches):
        cells = np.zeros(width * slices, np.int64)
        add(batches, cells)
        if cells.any():
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(range(slices), pa.int32()),
                "cells": pa.array([cells[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(slices)], pa.binary()),
            })

    return added_slices(df.mapInArrow(counts, "slice int, cells binary"), width, slices)[:size]


def added_slices(parts: DataFrame, width: int, slices: int, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum of counters that tasks sent as rows (slice, cells); with ``finish``, what it makes of the sums."""

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for cell in group.column("cells"):
            total += np.frombuffer(cell.as_buffer(), total_type(cell, width))
        return pa.table({"slice": group.column("slice").slice(0, 1).cast(pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    def finished(group: pa.Table) -> pa.Table:
        sums = added(group)
        if finish is None:
            return sums
        return sums.set_column(1, "cells", pa.array([finish(np.frombuffer(sums.column("cells")[0].as_py(), np.int64)).tobytes()], pa.binary()))

    kind = np.dtype(np.int64) if finish is None else finish(np.zeros(1, np.int64)).dtype
    parts = parts.withColumn("part", F.spark_partition_id() % 64)
    parts = parts.groupBy("slice", "part").applyInArrow(added, "slice int, cells binary")
    total = np.full(width * slices, 0 if finish is None else finish(np.zeros(1, np.int64))[0], kind)
    for row in parts.groupBy("slice").applyInArrow(finished, "slice int, cells binary").collect():  # ``slices`` rows
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["cells"], kind)
    return total


def total_type(cell, width: int):
    """Counters of one task have 32 bits, sums have 64."""
    return np.uint32 if len(cell.as_buffer()) == 4 * width else np.int64


# --- components ------------------------------------------------------------------------------------


def _forests(batches):
    """A spanning forest of each block of links: fewer links, the same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(node, parent=parent):
            while (above := parent.setdefault(node, node)) != node:
                parent[node] = node = parent[above]
            return node

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        links = [(node, root(node)) for node in parent if parent[node] != node]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), with the smallest node reachable as root.

    Large-star and small-star steps: each round hangs neighbours on smaller ones until only stars are left.
    Before that, each block of links is thinned to a forest where it lies. Links stay distributed; each round
    is written to the shared folder."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = written(edges.mapInArrow(_forests, "a long, b long").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.col("b").alias("x"), F.col("m").alias("y"))
            .unionByName(joined.select(F.col("a").alias("x"), F.col("m").alias("y")))
            .filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
        edges = written(small)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
