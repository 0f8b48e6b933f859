"""Structural candidate identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import ratio

# Names that signal an identifier, and the two sets of thresholds.
IDENTIFIER_NAMES = ("id", "identifier", "uuid", "guid")
IDENTIFIER_SUFFIX = "_id"
BY_NAME = {"min_row_count": 10, "min_completeness": 0.95, "min_uniqueness": 0.98}
BY_STRUCTURE = {"min_row_count": 100, "min_completeness": 0.99, "min_uniqueness": 0.999}
NAME_REASON = "name_signal_thresholds_v0_1"
STRUCTURE_REASON = "structural_thresholds_v0_1"


NAME_SIGNAL_SQL = (
    f"(lower(name) in ({', '.join(repr(name) for name in IDENTIFIER_NAMES)}) or endswith(lower(name), '{IDENTIFIER_SUFFIX}'))"
)
COMPLETENESS_SQL = "try_divide(double(non_null_count), double(row_count))"


def _meets(limits: dict) -> str:
    return (
        f"(row_count >= {limits['min_row_count']} and {COMPLETENESS_SQL} >= {limits['min_completeness']}D"
        f" and uniqueness_ratio >= {limits['min_uniqueness']}D)"
    )


_REASON_SQL = (
    f"case when {NAME_SIGNAL_SQL} and {_meets(BY_NAME)} then '{NAME_REASON}'"
    f" when not {NAME_SIGNAL_SQL} and {_meets(BY_STRUCTURE)} then '{STRUCTURE_REASON}' end"
)

# The candidate verdict, its reason and the measured completeness, from the counts of a column.
CANDIDATE_SQL = (
    f"{_REASON_SQL} as candidate_identifier_reason, ({_REASON_SQL}) is not null as is_candidate_identifier,"
    f" {NAME_SIGNAL_SQL} as has_name_signal, {COMPLETENESS_SQL} as completeness_ratio"
)


def candidate_identifiers(profile: DataFrame) -> DataFrame:
    """The candidates of each table in column order, with the thresholds they met."""

    def threshold(name: str) -> Column:
        return (
            F.when(F.col("has_name_signal"), F.lit(float(BY_NAME[name])))
            .otherwise(F.lit(float(BY_STRUCTURE[name])))
            .alias(name)
        )

    return profile.where("is_candidate_identifier").select(
        "table_name",
        "column_id",
        "position",
        "name",
        F.lit("STRUCTURAL_CANDIDATE_IDENTIFIER").alias("kind"),
        F.col("candidate_identifier_reason").alias("reason"),
        F.col("has_name_signal").alias("name_signal"),
        F.col("completeness_ratio").alias("completeness"),
        F.col("uniqueness_ratio").alias("uniqueness"),
        *[threshold(name) for name in BY_NAME],
        F.lit(False).alias("confirmed_key"),
    )
