"""Optional input limits; nothing is limited unless asked for, and a value at the limit passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gaugework.sources.errors import LimitExceeded


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    max_cells: int | None = None
    max_sheets: int | None = None


# The limits of an interactive upload.
UPLOAD_LIMITS = Limits(5 * 1024 * 1024, 100_000, 250, 1_000_000, 20)


def beyond(value: Column, limit: int | None) -> Column:
    return F.lit(False) if limit is None else value > limit


def limit_verdicts(tables: dict[str, DataFrame], limits: Limits) -> DataFrame:
    """Rows, columns, cells and the verdict of every table."""
    parts = []
    for name, frame in tables.items():
        width = len(frame.columns)
        counted = frame.select(F.lit(1).alias("one"))
        rows, cells = F.col("row_count"), F.col("row_count") * width
        broken = beyond(F.lit(width), limits.max_columns) | beyond(rows, limits.max_rows) | beyond(cells, limits.max_cells)
        parts.append(
            counted.agg(F.count("one").alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(width).alias("column_count"),
                cells.alias("cell_count"),
                F.when(broken, LimitExceeded.code).otherwise("accepted").alias("verdict"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def check_table(frame: DataFrame, limits: Limits) -> None:
    """Raises if a table is beyond a limit; nothing is counted unless rows or cells are limited."""
    width = len(frame.columns)
    if limits.max_columns is not None and width > limits.max_columns:
        raise LimitExceeded("the table is beyond the limits")
    if limits.max_rows is not None or limits.max_cells is not None:
        _check_rows(frame.count(), width, limits)


def _check_rows(rows: int, width: int, limits: Limits) -> None:
    if any(limit is not None and value > limit for value, limit in ((rows, limits.max_rows), (rows * width, limits.max_cells))):
        raise LimitExceeded("the table is beyond the limits")


class ObservedRows:
    """Rows and cells counted in the pass that uses a table, instead of one before it.

    ``frame`` is the table; once an action has run over all of it, ``check`` raises if it was beyond a limit and ``rows`` gives the
    count. The number of columns is known beforehand and checked at once.
    """

    def __init__(self, frame: DataFrame, limits: Limits = Limits()):
        check_table(frame, Limits(max_columns=limits.max_columns))
        self._seen, self._limits, self._width = Observation(), limits, len(frame.columns)
        self.frame = frame.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    @property
    def rows(self) -> int:
        return self._seen.get["rows"]

    def check(self) -> None:
        _check_rows(self.rows, self._width, self._limits)
