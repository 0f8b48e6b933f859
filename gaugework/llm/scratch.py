"""Tables that cut lineage: written below the shared checkpoint folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.session import shared_dir

#: Rows of two numbers at most that a broadcast may hold, some 50 MB.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """The tables of one operator call. A table is on the shared storage, so it outlives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/gaugework-llm/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def put(self, frame: DataFrame) -> DataFrame:
        """Writes the frame and returns it as read back."""
        self._count += 1
        path = f"{self.root}/{self._count}"
        frame.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(frame.schema).parquet(path)
        stored._scratch_path = path
        return stored

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def small(ids: DataFrame, count: int | None = None) -> DataFrame:
    """The frame of a few fixed-width columns, marked for a broadcast if its count proves it small. Joins give the same rows either way."""
    return F.broadcast(ids) if (ids.count() if count is None else count) <= BROADCAST_ROWS else ids
