"""Findings of the profiling stage: repeated rows, empty and constant columns, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugework.operators import judgements as J
from gaugework.operators.identifiers import BY_NAME, BY_STRUCTURE

ROW_RULE = "complete_row_duplicates_v0_1"
CANDIDATE_RULE = "candidate_identifier_v0_1"


def profiling_judgements(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    per_table = J.explode_judgements(duplicates, "PROFILING", [_repeated_rows()])
    per_column = J.explode_judgements(
        profile,
        "PROFILING",
        [
            _column_metric("is_all_null", "all_null", "WARNING", "Every value is null", "null_count", "row_count"),
            _column_metric(
                "is_constant", "constant_column", "INFO", "All filled cells hold the same value", "distinct_count",
                "non_null_count",
            ),
            _candidate(),
        ],
    )
    return per_table.unionByName(per_column)


def _repeated_rows() -> str:
    observed = "duplicate_excess_row_count"
    item = J.evidence(
        "'E-DATASET-DUPLICATE-ROWS'", "metric", "'dataset'", J.text(ROW_RULE), observed, observed, observed,
        affected_rows="duplicate_row_count",
    )
    finding = J.finding(
        finding_id="'F-DATASET-DUPLICATE-ROWS'", assertion_level="'DETECTED'", severity="'WARNING'",
        confidence="'HIGH'", category="'duplicate_record'", subject="'dataset'",
        title=J.text("Some rows occur repeatedly"),
        description=J.text("Rows that agree in every column were counted exactly."), method=J.text(ROW_RULE),
    )
    return J.judgement("0", finding, f"array({item})", f"{observed} > 0")


def _id(kind: str, suffix: str) -> str:
    return f"concat('{kind}-COL-', position, '-{suffix}')"


def _column_metric(where: str, category: str, severity: str, title: str, observed: str, denominator: str) -> str:
    suffix, rule = category.upper(), J.text(f"{category}_v0_1")
    finding = J.finding(
        finding_id=_id("F", suffix), assertion_level="'DETECTED'", severity=J.text(severity), confidence="'HIGH'",
        category=J.text(category), subject="column_id", title=J.text(title),
        description=J.text("Measured over the whole column."), method=rule,
    )
    item = J.evidence(
        _id("E", suffix), "metric", "column_id", rule, category, observed, observed, denominator, observed
    )
    return J.judgement("(position + 1) * 10", finding, f"array({item})", where)


def _candidate() -> str:
    thresholds = [
        J.detail(name, f"case when has_name_signal then '{BY_NAME[name]}' else '{BY_STRUCTURE[name]}' end")
        for name in BY_NAME
    ]
    details = [
        J.detail("row_count", "row_count"),
        J.detail("completeness", "completeness_ratio"),
        J.detail("uniqueness", "uniqueness_ratio"),
        J.detail("name_signal", "has_name_signal"),
        J.detail("matched_rule", "candidate_identifier_reason"),
        J.detail("rule_version", J.text(J.VERSION)),
        *thresholds,
    ]
    finding = J.finding(
        finding_id=_id("F", "CANDIDATE-IDENTIFIER"), assertion_level="'INFERRED'", severity="'INFO'",
        confidence="'HIGH'", category="'candidate_identifier'", subject="column_id",
        title=J.text("Column behaves like an identifier"),
        description=J.text("Inferred from counts only; no key constraint was checked or confirmed."),
        method=J.text(CANDIDATE_RULE),
    )
    item = J.evidence(
        _id("E", "CANDIDATE-IDENTIFIER"), "metric", "column_id", J.text(CANDIDATE_RULE),
        "candidate_identifier_rule_match", "candidate_identifier_reason", details=details,
    )
    return J.judgement("(position + 1) * 10 + 1", finding, f"array({item})", "is_candidate_identifier")
