"""Exact median, population deviation and text extremes of numeric columns, of any number of distinct values.

The measured values of all columns lie in ranges by column and number, written once. Weighted totals per range, a few numbers each, say
which range holds a column's middle ranks; only that range is ranked. So one scan of the data serves everything, and no task ever holds
more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import sql_over

#: The column that numbers the ranges; ranges of higher numbers hold greater keys.
PART = "part"


def in_ranges(values: DataFrame) -> DataFrame:
    """The values in ranges by ``column_key`` and ``number``, which may split a column but never a number, with the range's number."""
    ranged = values.repartitionByRange("column_key", "number").withColumn(PART, F.spark_partition_id())
    return ranged.sortWithinPartitions("column_key", "number")


def numeric_statistics(measured: DataFrame, types: DataFrame) -> DataFrame:
    """``column_key, median, stddev, minimum_text, maximum_text`` of the columns whose values are all numbers.

    ``measured`` are the values as :func:`in_ranges` gave them, stored, since the ranges may fall elsewhere when they are made again. The
    frames that are broadcast hold a row per column and range at most.
    """
    return sql_over(
        f"""
        with numeric as (
            select column_key, mean, shiftright(non_null_count - 1, 1) as low_rank, shiftright(non_null_count, 1) as high_rank
            from $types where inferred_type in ('INTEGER', 'FLOAT')),
        numbers as (
            select /*+ broadcast(s) */ s.*, m.{PART}, m.number, m.cells, m.minimum_text, m.maximum_text
            from $measured m join numeric s on m.column_key = s.column_key where m.number is not null),
        totals as (
            select column_key, {PART}, low_rank, high_rank, sum(cells) as cells,
                sum((number - mean) * (number - mean) * cells) as gaps,
                min(minimum_text) as minimum_text, max(maximum_text) as maximum_text
            from numbers group by column_key, {PART}, low_rank, high_rank),
        placed as (
            select *, coalesce(sum(cells) over (partition by column_key order by {PART}
                rows between unbounded preceding and 1 preceding), 0L) as below from totals),
        middle as (
            select column_key, {PART}, below from placed
            where low_rank between below and below + cells - 1 or high_rank between below and below + cells - 1),
        running as (
            select /*+ broadcast(p) */ n.column_key, number, low_rank, high_rank,
                below + sum(cells) over (partition by n.column_key, n.{PART} order by number rows unbounded preceding) as reached
            from numbers n join middle p on n.column_key = p.column_key and n.{PART} = p.{PART}),
        medians as (
            select column_key, (min(case when reached > low_rank then number end)
                + min(case when reached > high_rank then number end)) / 2D as median
            from running group by column_key),
        spread as (
            select column_key, sqrt(sum(gaps) / sum(cells)) as stddev,
                min(minimum_text) as minimum_text, max(maximum_text) as maximum_text
            from totals group by column_key)
        select column_key, median, stddev, minimum_text, maximum_text from spread join medians using (column_key)""",
        measured=measured,
        types=types,
    )
