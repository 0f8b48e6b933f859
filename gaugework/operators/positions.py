"""The place of each row, without a column that tells rows apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that Spark gives a row within its partition.
_ROW_BITS = 33


def with_positions(frame: DataFrame, name: str = "row_position") -> DataFrame:
    """Adds the place of each row, from 0.

    Rows of files that count them (Parquet) are placed in the order of the files' names and within the file. Those of other frames are placed
    in the order of their partitions, which must be the same whenever the frame is evaluated. Places are offsets, one number per file
    or partition, plus the place within, so rows are not moved.
    """
    if name in frame.columns:
        raise ValueError(f"{name} is already a column")
    try:
        placed = frame.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_at"))
        ends = placed.groupBy("_part").agg((F.max("_at") + 1).alias("_rows"))
    except AnalysisException:
        number = F.monotonically_increasing_id()
        placed = frame.select("*", F.shiftright(number, _ROW_BITS).alias("_part"), number.bitwiseAND((1 << _ROW_BITS) - 1).alias("_at"))
        ends = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # A row for each file or partition; their offsets follow from each other.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(*[F.col(f"`{column}`") for column in frame.columns], (F.col("_offset") + F.col("_at")).alias(name))
