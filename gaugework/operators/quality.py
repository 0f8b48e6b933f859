"""Structural quality: four dimensions, their applicability, and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import percent, ratio, score_band
from gaugework.functions.tokens import TYPED
from gaugework.operators import judgements as J

# The dimensions with their weights, and the limits of the consistency rule.
WEIGHTS = {"structural_completeness": 35, "uniqueness": 25, "validity": 25, "consistency": 15}
MIN_CONSISTENCY_VALUES = 10
MIN_VALID_SHARE = 0.98
# Shares of the uniqueness penalty.
IDENTIFIER_SHARE, ROW_SHARE = 0.8, 0.2

DUPLICATE_RULE = "QUALITY-IDENTIFIER-DUPLICATE-001"
MISSING_RULE = "QUALITY-IDENTIFIER-MISSING-001"
MALFORMED_RULE = "quality_validity_parser_v0_1"


def quality_by_table(profile: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per table: ``dimensions`` (array of four structs) and ``observed_completeness``."""
    measures = _table_measures(profile)
    # A repeated row is covered when an identifier column repeats with it, which any non-null
    # identifier does; so the uncovered ones are those whose identifiers are all null.
    nulls = F.split("null_positions", ",")
    all_null = (F.size("identifiers") > 0) & (F.size(F.array_except("identifiers", nulls)) == 0)
    # One row per table is broadcast onto the patterns, whose sums are then reduced before the shuffle.
    known = F.broadcast(measures.select("table_name", "identifiers"))
    sums = patterns.join(known, "table_name").groupBy("table_name").agg(
        F.sum("excess_rows").alias("row_excess"), F.sum(F.when(all_null, F.col("excess_rows"))).alias("uncovered")
    )
    folded = measures.join(sums, "table_name", "left").fillna(0, ["row_excess", "uncovered"])
    empty = F.col("row_count") == 0
    dimensions = F.array(_completeness(empty), _uniqueness(empty), _validity(empty), _consistency(empty))
    cells = F.col("cells")
    return folded.select(
        "table_name",
        "row_count",
        "column_count",
        dimensions.alias("dimensions"),
        F.when(cells > 0, percent(1.0 - ratio(F.col("nulls"), cells))).alias("observed_completeness"),
    )


def quality_dimensions(by_table: DataFrame) -> DataFrame:
    return by_table.select("table_name", F.explode("dimensions").alias("dimension")).select("table_name", "dimension.*")


def quality_score(by_table: DataFrame) -> DataFrame:
    """Overall score over the applicable dimensions only, with the weights applied."""
    applied = F.filter("dimensions", lambda item: item["applicability"] == "APPLICABLE")
    weighted = F.aggregate("applied", F.lit(0.0), lambda total, item: total + item["score"] * item["weight"])
    weights = F.aggregate("applied", F.lit(0), lambda total, item: total + item["weight"])
    reasons = F.filter("dimensions", lambda item: item["reason"].isNotNull())
    overall = F.bround(F.try_divide(weighted, weights), 0).cast("bigint")
    scored = by_table.withColumn("applied", applied).withColumn("overall_score", overall)
    return scored.select(
        "table_name",
        "overall_score",
        score_band(F.col("overall_score")).alias("score_band"),
        "observed_completeness",
        F.transform("applied", lambda item: F.struct(item["name"].alias("name"), item["weight"].alias("weight"))).alias(
            "applied_weights"
        ),
        F.transform(
            "dimensions",
            lambda item: F.struct(item["name"].alias("name"), item["applicability"].alias("applicability")),
        ).alias("applicability"),
        F.transform(
            reasons, lambda item: F.struct(item["name"].alias("name"), item["reason"].alias("reason"))
        ).alias("not_applicable_reasons"),
    )


def quality_judgements(profile: DataFrame) -> DataFrame:
    """Repeated and missing identifiers column by column, then malformed values."""
    return J.explode_judgements(
        profile,
        "QUALITY",
        [
            _identifier_judgement(
                "position * 2L", "DUPLICATE-IDENTIFIER", "duplicate_structural_identifier", DUPLICATE_RULE,
                "duplicate_excess_rows", "non_null_count", "Identifier values repeat",
                "rows repeat an identifier value seen before in",
            ),
            _identifier_judgement(
                "position * 2L + 1", "MISSING-IDENTIFIER", "structural_identifier_missingness", MISSING_RULE,
                "null_count", "row_count", "Identifier values are missing", "rows have no identifier value in",
            ),
            _malformed(),
        ],
    )


def _table_measures(profile: DataFrame) -> DataFrame:
    candidate = F.col("is_candidate_identifier")
    typed = F.col("parser_type").isin(*TYPED)
    filled, valid = F.col("non_null_count"), F.col("valid_count")
    consistent = (
        typed & (filled >= MIN_CONSISTENCY_VALUES) & (ratio(valid, filled) >= MIN_VALID_SHARE)
    )
    biggest = F.coalesce(
        F.array_max(F.transform("format_family_counts", lambda item: item["count"])), F.lit(0).cast("bigint")
    )

    def total(where: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    return profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("row_count").alias("cells"),
        F.sum("null_count").alias("nulls"),
        F.count_if(candidate).alias("candidates"),
        total(candidate, F.col("null_count")).alias("candidate_nulls"),
        F.avg(F.when(candidate, ratio(F.col("duplicate_excess_rows"), filled))).alias("identifier_rate"),
        # One text per column of the table, so the list is bounded by the schema.
        F.array_sort(F.collect_list(F.when(candidate, F.col("position").cast("string")))).alias("identifiers"),
        total(typed, filled).alias("typed_values"),
        total(typed, F.col("invalid_count")).alias("invalid_values"),
        F.coalesce(F.bool_or(consistent), F.lit(False)).alias("any_consistent"),
        total(consistent, valid).alias("consistent_values"),
        total(consistent, valid - biggest).alias("inconsistent_values"),
        F.coalesce(
            F.bool_or(F.col("has_recognized_family") & (filled < MIN_CONSISTENCY_VALUES)), F.lit(False)
        ).alias("any_short_family"),
    )


def _dimension(name: str, empty: Column, reason: Column, insufficient: Column, score: Column, part: Column, whole: Column):
    """Struct of one dimension; ``reason`` is null when the dimension applies."""
    reason = F.when(empty, "empty_dataset").otherwise(reason)
    applies = reason.isNull()
    applicability = (
        F.when(applies, "APPLICABLE").when(empty | insufficient, "INSUFFICIENT_DATA").otherwise("NOT_APPLICABLE")
    )
    return F.struct(
        F.lit(list(WEIGHTS).index(name)).alias("dimension_rank"),
        F.lit(name).alias("name"),
        F.lit(WEIGHTS[name]).alias("weight"),
        F.when(applies, score).alias("score"),
        applicability.alias("applicability"),
        reason.alias("reason"),
        F.when(applies, part).cast("bigint").alias("numerator"),
        F.when(applies, whole).cast("bigint").alias("denominator"),
    )


def _completeness(empty: Column) -> Column:
    whole = F.col("row_count") * F.col("candidates")
    return _dimension(
        "structural_completeness", empty,
        F.when(F.col("candidates") == 0, "no_structural_candidate_identifier"), F.lit(False),
        percent(1.0 - ratio(F.col("candidate_nulls"), whole)), whole - F.col("candidate_nulls"), whole,
    )


def _uniqueness(empty: Column) -> Column:
    rows = F.col("row_count")
    with_candidates = F.col("candidates") > 0
    penalty = F.least(
        F.lit(1.0), IDENTIFIER_SHARE * F.col("identifier_rate") + ROW_SHARE * ratio(F.col("uncovered"), rows)
    )
    share = F.when(with_candidates, 1.0 - penalty).otherwise(1.0 - ratio(F.col("row_excess"), rows))
    part = rows - F.when(with_candidates, F.col("uncovered")).otherwise(F.col("row_excess"))
    reason = F.when(~with_candidates & (rows < 2), "fewer_than_two_rows")
    return _dimension("uniqueness", empty, reason, reason.isNotNull(), percent(share), part, rows)


def _validity(empty: Column) -> Column:
    whole, bad = F.col("typed_values"), F.col("invalid_values")
    return _dimension(
        "validity", empty, F.when(whole == 0, "no_typed_columns"), F.lit(False),
        percent(1.0 - ratio(bad, whole)), whole - bad, whole,
    )


def _consistency(empty: Column) -> Column:
    whole, bad = F.col("consistent_values"), F.col("inconsistent_values")
    short = F.col("any_short_family")
    reason = F.when(
        ~F.col("any_consistent"),
        F.when(short, "fewer_than_10_valid_non_null_values").otherwise("no_recognized_format_family"),
    )
    return _dimension("consistency", empty, reason, short, percent(1.0 - ratio(bad, whole)), whole - bad, whole)


def _id(kind: str, suffix: str) -> str:
    return f"concat('{kind}-QUALITY-COL-', position, '-{suffix}')"


def _identifier_judgement(
    order: str, suffix: str, category: str, rule: str, metric: str, denominator: str, title: str, phrase: str
) -> str:
    details = [
        J.detail("column_id", "column_id"),
        J.detail("column_position", "position"),
        J.detail("row_count", "row_count"),
        J.detail("non_null_count", "non_null_count"),
        J.detail("structural_candidate_identifier", "true"),
        J.detail("model_version", J.text(J.VERSION)),
        J.detail(metric, metric),
    ]
    finding = J.finding(
        finding_id=_id("F", suffix), assertion_level="'DETECTED'", severity="'WARNING'", confidence="'HIGH'",
        category=J.text(category), subject="column_id", title=J.text(title),
        description=f"concat({metric}, ' {phrase} ', name, '.')", method=J.text(rule),
    )
    item = J.evidence(
        _id("E", suffix), "metric", "column_id", J.text(rule), metric, metric, metric, denominator, metric, details
    )
    return J.judgement(order, finding, f"array({item})", f"is_candidate_identifier and {metric} > 0")


def _malformed() -> str:
    bad, rule = "invalid_count", J.text(MALFORMED_RULE)
    finding = J.finding(
        finding_id=_id("F", "MALFORMED-VALUE"), assertion_level="'DETECTED'", severity="'WARNING'", confidence="'HIGH'",
        category="'malformed_value'", subject="column_id", title=J.text("Some values do not parse"),
        description=f"concat({bad}, ' filled cells are not of type ', parser_type, '.')", method=rule,
    )
    details = [J.detail("expected_primitive_type", "parser_type"), J.detail("parser_rule", rule)]
    item = J.evidence(
        _id("E", "MALFORMED-VALUE"), "metric", "column_id", rule, "invalid_non_null_count", bad, bad, "non_null_count",
        bad, details,
    )
    # After all identifier findings of the table.
    return J.judgement(f"{1 << 40}L + position", finding, f"array({item})", f"{bad} > 0")
