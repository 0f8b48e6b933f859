"""Small shared scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(share: Column) -> Column:
    """A share held within 0..1, as a percentage with two decimals, halves to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 100.0, 2)


def base36(number: Column) -> Column:
    """A non-negative whole number in lower-case base 36."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def display_ratio(share: Column) -> Column:
    """A ratio for display: one decimal, no trailing ``.0``, a dash for null."""
    return _display(F.round(share * 100.0, 1))


def display_score(score: Column) -> Column:
    """A 0..100 score for display: one decimal, no trailing ``.0``, a dash for null."""
    return _display(F.round(score, 1))


def score_band(score: Column) -> Column:
    """The documented band of an overall score."""
    # The documented band limits.
    return (
        F.when(score >= 90, "90-100")
        .when(score >= 75, "75-89")
        .when(score >= 50, "50-74")
        .when(score.isNotNull(), "<50")
    )


def any_of(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _display(number: Column) -> Column:
    text = F.regexp_replace(F.format_string("%.1f", number), r"\.0$", "")
    return F.when(number.isNull(), F.lit("—")).otherwise(F.concat(text, F.lit("%")))
