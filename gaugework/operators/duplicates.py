"""Complete-row duplicates and the flagging of repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators import cells as C
from gaugework.operators.positions import with_positions


def duplicate_patterns(histogram: DataFrame, tables: DataFrame) -> DataFrame:
    """Groups of equal rows, summed per table and set of null columns.

    The null columns are kept because the quality score asks which repeated rows lack every
    candidate identifier.
    """
    # One condition over ``n`` as well as the lane, so that the histogram's shuffle stays shared.
    repeated = histogram.where(f"case when n > 1 then column_key % {C.LANES} end = {C.ROW}")
    patterns = repeated.groupBy(
        "column_key", F.substring_index("body", "|", -1).alias("null_positions")
    ).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("excess_rows"), F.count(F.lit(1)).alias("groups")
    )
    return tables.select("column_key", "table_name").join(patterns, "column_key").drop("column_key")


def duplicate_rows(patterns: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows in repeated groups, rows beyond the first of each, and the number of groups, per table."""
    totals = patterns.groupBy("table_name").agg(
        F.sum("rows").alias("duplicate_row_count"),
        F.sum("excess_rows").alias("duplicate_excess_row_count"),
        F.sum("groups").alias("complete_duplicate_group_count"),
    )
    return (
        tables.select("table_name")
        .join(totals, "table_name", "left")
        .fillna(0, ["duplicate_row_count", "duplicate_excess_row_count", "complete_duplicate_group_count"])
    )


def flag_repeated_rows(frame: DataFrame, order_key: str, columns: list[str] | None = None) -> DataFrame:
    """Adds ``is_excess``: whether an earlier row, by the unique ``order_key``, equals this one.

    Earlier means a smaller key, so a row is excess exactly when it is not its group's minimum. That
    needs no sorted group: minima come from a map-side aggregation, and the join back to them has one row on
    one side, so adaptive execution can split a group that holds a third of the table.
    """
    names = columns or [name for name in frame.columns if name != order_key]
    return _flag(frame, names, order_key, F.lit(True))


def flag_repeated_values(frame: DataFrame, order_key: str, column: str) -> DataFrame:
    """The same for the non-null values of one column; null values are never excess."""
    return _flag(frame, [column], order_key, F.col(f"`{column}`").isNotNull())


def repeated_row_positions(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``row_position`` of every row that equals an earlier one in the given columns, or in all; nulls equal nulls.

    Only a key of each row and its place are moved. The frame needs no column that tells rows apart.
    """
    return _excess(frame, columns or frame.columns, F.lit(True))


def repeated_value_positions(frame: DataFrame, column: str) -> DataFrame:
    """The same for the non-null values of one column."""
    return _excess(frame, [column], F.col(f"`{column}`").isNotNull())


def _excess(frame: DataFrame, names: list[str], eligible: Column) -> DataFrame:
    columns = [(f"`{name}`", frame.schema[name].dataType) for name in names]
    text = F.expr(C.row_text(columns))
    keyed = with_positions(frame).where(eligible).select("row_position", F.sha2(text, 256).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("row_position").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    return keyed.join(firsts, "key").where("row_position > first").select("row_position")


def _flag(frame: DataFrame, names: list[str], order_key: str, eligible: Column) -> DataFrame:
    columns = [(f"`{name}`", frame.schema[name].dataType) for name in names]
    keyed = frame.withColumn("_text", F.expr(C.row_text(columns))).withColumn(
        "_row", F.expr(C.row_body("_text", columns))
    )
    firsts = (
        keyed.where(eligible)
        .groupBy("_row")
        .agg(F.min(order_key).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_row", "_first")
    )
    excess = eligible & F.col("_first").isNotNull() & (F.col(order_key) > F.col("_first"))
    flagged = keyed.join(firsts, "_row", "left").withColumn("is_excess", excess)
    return flagged.select(*frame.columns, "is_excess")
