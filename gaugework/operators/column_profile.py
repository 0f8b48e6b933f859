"""One row per column: counts, types, families, statistics and the candidate verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.tokens import LEADING_ZERO, TYPED
from gaugework.operators.histogram import NULL_FAMILY, distinct_counts, family_counts_cte
from gaugework.operators.identifiers import CANDIDATE_SQL
from gaugework.session import sql_over

# Agreement needed for a quality parser, and for the leading-zero protection.
PARSER_AGREEMENT = 0.98
LEADING_ZERO_PERCENT = 95

COUNTS = ["row_count", "non_null_count", "distinct_count"]

_VERDICTS = """
    row_count, non_null_count, distinct_count,
    row_count - non_null_count as null_count,
    row_count > non_null_count as nullable,
    coalesce(try_divide(double(row_count - non_null_count), double(row_count)), 0D) as null_ratio,
    try_divide(double(distinct_count), double(non_null_count)) as uniqueness_ratio,
    try_divide(double(distinct_count), double(non_null_count)) as cardinality_ratio,
    non_null_count - distinct_count as duplicate_excess_rows,
    non_null_count > 0 and distinct_count = 1 as is_constant,
    row_count > 0 and non_null_count = 0 as is_all_null"""

_IDENTITY = "table_name, position, concat('col:', position) as column_id, name, physical_dtype"


def column_counts(histogram: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counts, ratios, flags and candidates only; no value is parsed."""
    # One row per column: bounded by the schema, as are all broadcasts of this module.
    counted = catalogue.join(F.broadcast(distinct_counts(histogram)), "column_key", "left").fillna(0, COUNTS)
    return sql_over(f"select *, {CANDIDATE_SQL} from (select {_IDENTITY}, {_VERDICTS} from $counted)", counted=counted)


def column_types(measured: DataFrame) -> DataFrame:
    """One row per ``column_key`` of the measured values: counts, types, families and the statistics that need no order."""
    ctes = [family_counts_cte("$measured"), _summary_cte(), *_type_ctes()]
    return sql_over(f"with {', '.join(ctes)} select * from types", measured=measured)


def column_profile(types: DataFrame, catalogue: DataFrame, statistics: DataFrame) -> DataFrame:
    """The full profile of every catalogue column, also of those whose table has no rows."""
    query = f"""
        with joined as (
            select /*+ broadcast(m, s) */ c.table_name, c.position, c.name, c.physical_dtype,
                coalesce(m.row_count, 0L) as row_count, coalesce(m.non_null_count, 0L) as non_null_count,
                coalesce(m.distinct_count, 0L) as distinct_count,
                m.* except (column_key, row_count, non_null_count, distinct_count),
                s.median, s.stddev, s.minimum_text, s.maximum_text
            from $catalogue c left join $types m on c.column_key = m.column_key
            left join $statistics s on c.column_key = s.column_key),
        counted as (select {_IDENTITY}, {_VERDICTS}, * except (
            table_name, position, name, physical_dtype, row_count, non_null_count, distinct_count) from joined)
        select table_name, position, column_id, name, physical_dtype, row_count, non_null_count, distinct_count,
            null_count, nullable, null_ratio, uniqueness_ratio, cardinality_ratio, duplicate_excess_rows,
            is_constant, is_all_null,
            coalesce(inferred_type, 'NULL') as inferred_type, coalesce(parser_type, 'NULL') as parser_type,
            coalesce(valid_count, 0L) as valid_count, coalesce(invalid_count, 0L) as invalid_count,
            coalesce(has_recognized_family, false) as has_recognized_family,
            coalesce(format_family_counts, cast(array() as array<struct<family:string,count:bigint>>)) as format_family_counts,
            {_statistics_sql()} as basic_statistics,
            {CANDIDATE_SQL}
        from counted"""
    return sql_over(query, types=types, catalogue=catalogue, statistics=statistics)


def _summary_cte() -> str:
    """Folds the few family rows of a column into one row. At most 16 family names exist, so the
    collected list cannot grow with the data."""
    per_kind = ", ".join(
        f"coalesce(sum(case when startswith(family, '{kind}_') then strict_cells end), 0L) as strict_{kind}, "
        f"coalesce(sum(case when startswith(family, '{kind}_') then cells end), 0L) as valid_{kind}"
        for kind in TYPED
    )
    return f"""summary as (
        select column_key, sum(cells) as row_count,
            coalesce(sum(case when family <> '{NULL_FAMILY}' then cells end), 0L) as non_null_count,
            coalesce(sum(case when family <> '{NULL_FAMILY}' then distinct_values end), 0L) as distinct_count,
            coalesce(sum(case when family = '{LEADING_ZERO}' then strict_cells end), 0L) as strict_leading_zero,
            coalesce(sum(case when family = '{LEADING_ZERO}' then cells end), 0L) as leading_zero,
            {per_kind},
            sum(number_sum) as number_sum, min(number_min) as number_min, max(number_max) as number_max,
            min(ordinal_min) as ordinal_min, max(ordinal_max) as ordinal_max, sum(ordinal_cells) as ordinal_cells,
            sum(length_sum) as length_sum, min(length_min) as length_min, max(length_max) as length_max,
            array_sort(collect_list(named_struct('family', family, 'count', cells))) as families
        from family_counts group by column_key)"""


def _type_ctes() -> list[str]:
    """Profiling type (every value agrees), quality parser (98 % agree) and the format families."""
    inferred = " ".join(f"when strict_{kind} = non_null_count then '{kind}'" for kind in TYPED)
    parser = " ".join(
        f"when double(valid_{kind}) / double(non_null_count) >= {PARSER_AGREEMENT}D then '{kind}'" for kind in TYPED
    )
    valid = " ".join(f"when '{kind}' then valid_{kind}" for kind in TYPED)
    any_valid = " + ".join(f"valid_{kind}" for kind in TYPED)
    return [
        f"""chosen as (
            select *,
                case when non_null_count = 0 then 'NULL' when strict_leading_zero = non_null_count then 'STRING'
                    {inferred} else 'STRING' end as inferred_type,
                case when non_null_count = 0 then 'NULL'
                    when leading_zero * 100 >= non_null_count * {LEADING_ZERO_PERCENT} then 'STRING'
                    {parser} else 'STRING' end as parser_type
            from summary)""",
        f"""types as (
            select column_key, row_count, non_null_count, distinct_count, inferred_type, parser_type,
                case parser_type {valid} else 0L end as valid_count,
                case when parser_type in ('NULL', 'STRING') then 0L
                    else non_null_count - case parser_type {valid} end end as invalid_count,
                non_null_count > 0 and {any_valid} > 0 as has_recognized_family,
                filter(families, item -> startswith(item.family, concat(parser_type, '_'))) as format_family_counts,
                number_min, number_max, ordinal_min, ordinal_max, ordinal_cells, length_sum, length_min, length_max,
                case when inferred_type in ('INTEGER', 'FLOAT') then number_sum / double(non_null_count) end as mean
            from chosen)""",
    ]


def _statistics_sql() -> str:
    """Struct of the statistics that belong to the inferred type; the other fields stay null. A
    physical number that ends up as STRING (not-a-number, infinity) has no length and no struct."""
    is_number = "inferred_type in ('INTEGER', 'FLOAT')"
    exact = "inferred_type = 'INTEGER' and ordinal_cells = non_null_count"
    fields = {
        "minimum_number": (is_number, "number_min"),
        "maximum_number": (is_number, "number_max"),
        "minimum_integer": (exact, "ordinal_min"),
        "maximum_integer": (exact, "ordinal_max"),
        "minimum_date": ("inferred_type = 'DATE'", "date_from_unix_date(cast(ordinal_min as int))"),
        "maximum_date": ("inferred_type = 'DATE'", "date_from_unix_date(cast(ordinal_max as int))"),
        "minimum_datetime": ("inferred_type = 'DATETIME'", "timestamp_micros(ordinal_min)"),
        "maximum_datetime": ("inferred_type = 'DATETIME'", "timestamp_micros(ordinal_max)"),
        "mean": (is_number, "mean"),
        "min_length": ("inferred_type = 'STRING'", "length_min"),
        "max_length": ("inferred_type = 'STRING'", "length_max"),
        "average_length": ("inferred_type = 'STRING'", "double(length_sum) / double(non_null_count)"),
    } | {name: (is_number, name) for name in ("median", "stddev", "minimum_text", "maximum_text")}
    items = ", ".join(f"'{name}', case when {where} then {value} end" for name, (where, value) in fields.items())
    has_any = (
        "inferred_type in ('INTEGER', 'FLOAT', 'DATE', 'DATETIME')"
        " or (inferred_type = 'STRING' and length_min is not null)"
    )
    return f"case when {has_any} then named_struct({items}) end"
