"""Shared scratch space for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_SETTING = "spark.sql.shuffle.partitions"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a new local one only in local mode (tests)."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder that the driver and all executors share.")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="roadrisk-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, not created yet."""
    return f"{shared_folder(spark).rstrip('/')}/roadrisk-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that later steps neither recompute it nor depend on the
    disks of single executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int, rows_per_task: int) -> Iterator[None]:
    """While it holds, shuffles have a partition for every ``rows_per_task`` rows, and never fewer than the session asks for.

    A fixed number of partitions grows with the input until each is sorted on disk. For eager work only.
    """
    before = spark.conf.get(SHUFFLE_SETTING)
    spark.conf.set(SHUFFLE_SETTING, max(int(before), -(-rows // rows_per_task)))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_SETTING, before)
