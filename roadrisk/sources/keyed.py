"""Tables with one row per key that take batches by merging.

Rows are dealt to buckets. A batch rewrites the buckets it touches as files of its own version, and then a list of the version
of each bucket; readers follow the newest list. A batch that is run again starts from the list before it and gives the same table.
Files that neither the newest list nor the one before it names are removed, so that a table of any age has one version or two
of each bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET = "_bucket"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    path, files = _files(spark, folder)
    return sorted(entry.getPath().getName() for entry in files.listStatus(path)) if files.exists(path) else []


def exists(spark: SparkSession, folder: str) -> bool:
    path, files = _files(spark, folder)
    return files.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _files(spark, folder)
    files.delete(path, True)


def by_hash(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


class KeyedTable:
    """A folder of versions. ``combine`` makes one row per key of rows that may be merged already; ``bucket`` deals rows by
    key, by hash or, where the key holds a time, by time first, so that a batch rewrites the times it has."""

    def __init__(self, spark: SparkSession, folder: str, bucket: Column, combine: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.folder, self.bucket, self.combine = spark, folder, bucket, combine

    def _lists(self) -> list[int]:
        names = children(self.spark, f"{self.folder}/lists")
        return sorted(int(n) for n in names if exists(self.spark, f"{self.folder}/lists/{n}/_SUCCESS"))

    def _list(self, version: int | None) -> dict[int, int]:
        """Version of each bucket; one row per bucket."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket long, version long").parquet(f"{self.folder}/lists/{version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _path(self, bucket: int, version: int) -> str:
        return f"{self.folder}/rows/{version}/{BUCKET}={bucket}"

    def _rows(self, places: dict[int, int], schema: StructType) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(b, v) for b, v in places.items()])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take the rows of batch ``number``; numbers grow."""
        before = max((v for v in self._lists() if v < number), default=None)
        places = self._list(before)
        fresh = self.combine(batch).withColumn(BUCKET, self.bucket).persist()
        try:
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
            if not touched:
                return
            fresh_rows = fresh.drop(BUCKET)
            old = self._rows({b: places[b] for b in touched if b in places}, fresh_rows.schema)
            merged = self.combine(old.unionByName(fresh_rows)).withColumn(BUCKET, self.bucket)
            merged.repartition(len(touched), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/rows/{number}")
        finally:
            fresh.unpersist()
        now = places | {b: number for b in touched}
        listed = self.spark.createDataFrame(list(now.items()), "bucket long, version long").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.folder}/lists/{number}")
        self._tidy(number, before, {(v, b) for named in (now, places) for b, v in named.items()})

    def _tidy(self, number: int, before: int | None, named: set[tuple[int, int]]) -> None:
        versions = {v for v, _ in named}
        for version in map(int, children(self.spark, f"{self.folder}/rows")):
            if version not in versions:
                remove(self.spark, f"{self.folder}/rows/{version}")
                continue
            for name in children(self.spark, f"{self.folder}/rows/{version}"):
                if name.startswith(f"{BUCKET}=") and (version, int(name.split("=")[1])) not in named:
                    remove(self.spark, f"{self.folder}/rows/{version}/{name}")
        for version in self._lists():
            if version not in (number, before):
                remove(self.spark, f"{self.folder}/lists/{version}")

    def read(self, schema: StructType) -> DataFrame:
        """The table after the last complete batch."""
        return self._rows(self._list(max(self._lists(), default=None)), schema)
