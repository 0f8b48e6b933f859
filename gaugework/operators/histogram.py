"""Value histogram of the cells and the per-column family counts drawn from it.

The histogram is the only wide shuffle of an analysis: cells collapse on the map side, so a value
that fills a third of a table reaches its reducer as one row per task. Every predicate, length and
number is then worked out once per distinct value and weighted with its count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.ordering import is_finite
from gaugework.functions.tokens import NO_FAMILY, date_number, datetime_number, is_strict, token_family, token_of
from gaugework.operators import cells as C
from gaugework.session import sql_over

NULL_FAMILY = "NULL"

# What each lane's values count as when they are not text.
_PHYSICAL = {
    C.BOOLEAN: "BOOLEAN_PHYSICAL",
    C.INTEGER: "INTEGER_PHYSICAL",
    C.DECIMAL_WHOLE: "INTEGER_PHYSICAL",
    C.FLOAT: "FLOAT_PHYSICAL",
    C.DECIMAL: "FLOAT_PHYSICAL",
    C.DATE: "DATE_PHYSICAL",
    C.DATETIME: "DATETIME_PHYSICAL",
}


def value_histogram(cells: DataFrame) -> DataFrame:
    """``(column_key, whole, real, body, n)``: each distinct value of each column with its count."""
    return cells.groupBy("column_key", "whole", "real", "body").agg(F.count(F.lit(1)).alias("n"))


def facts_ctes(histogram: str) -> list[str]:
    """CTEs that end in ``facts``: family, strict flag, number, ordinal and length of each value."""
    is_number = "strict and (startswith(family, 'INTEGER_') or startswith(family, 'FLOAT_'))"
    physical = " ".join(f"when {code} then '{family}'" for code, family in _PHYSICAL.items())
    return [
        # A filled ``whole`` on the TEXT lane marks the digest of a long text, which is no token.
        f"""raws as (
            select *, column_key % {C.LANES} as lane,
                case when column_key % {C.LANES} = {C.TEXT} and whole is null then body end as raw
            from {histogram})""",
        f"tokens as (select *, {token_of('raw')} as token from raws)",
        f"""families as (
            select *, case
                when whole is null and real is null and body is null then '{NULL_FAMILY}'
                when lane = {C.TEXT} then {token_family('token')}
                when real is not null and not {is_finite('real')} then '{NO_FAMILY}'
                else case lane {physical} else '{NO_FAMILY}' end end as family
            from tokens)""",
        f"""stricts as (
            select *, endswith(family, '_PHYSICAL') or coalesce({is_strict('raw', 'token', 'family')}, false) as strict
            from families)""",
        f"""facts as (
            select column_key, family, strict, n,
                case when {is_number} then coalesce(real, cast(whole as double), try_cast(raw as double)) end as number,
                case when {is_number} then raw end as number_text,
                case when strict then case
                    when raw is null then whole
                    when family = 'DATE_ISO' then {date_number('raw')}
                    when startswith(family, 'DATETIME_') then {datetime_number('raw')}
                    else try_cast(raw as bigint) end end as ordinal,
                case when lane = {C.TEXT} then coalesce(whole, cast(char_length(raw) as bigint)) end as length
            from stricts)""",
    ]


MEASURES = ("cells", "distinct_values", "strict_cells", "ordinal_cells", "ordinal_min", "ordinal_max", "length_sum", "length_min", "length_max")


def measured_values(histogram: DataFrame) -> DataFrame:
    """The histogram without what only tells values apart: one row per column, family and number.

    Values that are no numbers collapse on the map side, so of any column there remain its different numbers, with the first and last of
    their texts, and a row per family.
    """
    return sql_over(
        f"""
        with {', '.join(facts_ctes('$histogram'))}
        select column_key, family, number,
            sum(n) as cells, count(*) as distinct_values,
            sum(case when strict then n end) as strict_cells,
            sum(case when ordinal is not null then n end) as ordinal_cells,
            min(ordinal) as ordinal_min, max(ordinal) as ordinal_max,
            sum(length * n) as length_sum, min(length) as length_min, max(length) as length_max,
            min(number_text) as minimum_text, max(number_text) as maximum_text
        from facts group by column_key, family, number""",
        histogram=histogram,
    )


def family_counts_cte(measured: str) -> str:
    """The CTE ``family_counts``: one row per column and family."""
    folded = ", ".join(f"{'min' if name.endswith('_min') else 'max' if name.endswith('_max') else 'sum'}({name}) as {name}" for name in MEASURES)
    return f"""family_counts as (
        select column_key, family, {folded},
            sum(number * cells) as number_sum, min(number) as number_min, max(number) as number_max
        from {measured} where family is not null group by column_key, family)"""


def distinct_counts(histogram: DataFrame) -> DataFrame:
    """Rows, non-null cells and distinct values per column, without looking into the values."""
    filled = "(whole is not null or real is not null or body is not null)"
    return histogram.groupBy("column_key").agg(
        F.expr("sum(n) as row_count"),
        F.expr(f"coalesce(sum(case when {filled} then n end), 0) as non_null_count"),
        F.expr(f"count_if({filled}) as distinct_count"),
    )
